"""Query registry: importing it loads every query module."""

from __future__ import annotations


def _load():
    from corpusloom.plans import (  # noqa: F401
        catalog_queries,
        context_queries,
        element_queries,
        evaluation_queries,
        ingest_queries,
        registry,
        retrieval_queries,
        search_queries,
        text_queries,
        usage_queries,
    )

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
