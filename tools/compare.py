"""Run queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """(ok, message) for one query."""
    start = time.time()
    df = fn(spark, sf_dir)
    table = df.toArrow()
    took = time.time() - start
    got = list(zip(*[c.to_pylist() for c in table.columns])) if table.num_rows else []
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return False, f"plan has a {bad}"
    if sql is None:
        return table.num_rows > 0, f"spark {took:.2f}s, rows only: {table.num_rows}"
    result = con.execute(sql)
    want_cols = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return False, f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (f"{len(a)} vs {len(b)} rows; only spark {list(sa - sb)[:2]}; "
                       f"only sql {list(sb - sa)[:2]}")
    return len(a) > 0, f"spark {took:.2f}s, {len(a)} rows"


def main():
    from corpusloom.plans import all_queries, all_sql
    from corpusloom.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(os.environ.get("CORES", "8"))
    con = connect(sf_dir)
    queries, sqls = all_queries(), all_sql()
    bad = []
    for name in args[1:] or queries:
        start = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, queries[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {message[:1800]}",
              flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    spark.stop()
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
