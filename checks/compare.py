"""Run registered queries and their SQL side by side: python -m checks.compare [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from reviewlab.session import build_session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def open_tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def as_rows(names: list[str], data: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


EMPTY = "no rows on both sides"


def differences(spark, con, sf: str, query, sql: str) -> str:
    """Empty if both sides give the same columns, types and rows."""
    ours = query(spark, sf)
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    if sorted(names) != sorted(ours.columns):
        return f"columns {sorted(ours.columns)} / {sorted(names)}"
    a, b = as_rows(ours.columns, ours.collect()), as_rows(names, theirs.fetchall())
    if a == b:
        return "" if a else EMPTY
    only_a, only_b = a - b, b - a
    return (f"rows {a.total()} / {b.total()}, {only_a.total()} differ\n    spark {next(iter(only_a), None)!r}"
            f"\n    sql   {next(iter(only_b), None)!r}")


def main() -> int:
    from checks import QUERIES, SQL

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in SQL:
                problem = differences(spark, con, sf, QUERIES[name], SQL[name])
                kind = "sql"
            else:
                n = QUERIES[name](spark, sf).count()
                problem, kind = ("" if n else "no rows"), f"rows={n}"
        except Exception as e:
            problem, kind = f"{type(e).__name__}: {str(e)[:700]}", "error"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {kind:10} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
