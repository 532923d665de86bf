"""Named queries over the test tables, each with its comparison SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql, needs)
        return fn

    return add


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = body
    _NEEDS[name] = needs


def with_ctes(body: str, needs: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in _NEEDS[name]:
            visit(inner)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body
