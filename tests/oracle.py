"""Compare a registered query with its SQL counterpart, column by column and value by value.

As a script: python tests/oracle.py /root/testdata/sf0.01 [names...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def expected_rows(con, sql: str) -> tuple[list[str], Counter]:
    result = con.sql(sql)
    columns = sorted(result.columns)
    places = [result.columns.index(c) for c in columns]
    return columns, Counter(tuple(row[p] for p in places) for row in result.fetchall())


def actual_rows(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect())


def typed(rows: Counter) -> list[set]:
    """Python types seen per column; equal values of unlike types (1 and 1.0) must not pass."""
    seen: list[set] = []
    for row in rows:
        seen = seen or [set() for _ in row]
        for types, value in zip(seen, row):
            types.add(type(value).__name__)
    return seen


def difference(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    columns, want = expected_rows(con, sql)
    got_columns, got = actual_rows(df)
    if columns != got_columns:
        return f"columns {got_columns} instead of {columns}"
    if want != got:
        missing, extra = want - got, got - want
        return (
            f"{sum(got.values())} rows instead of {sum(want.values())}; "
            f"missing {list(missing.items())[:3]}, extra {list(extra.items())[:3]}"
        )
    if typed(want) != typed(got):
        return f"types {typed(got)} instead of {typed(want)}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from millrace.session import build_local

    spark = build_local(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = difference(df, con, sql[name]) if name in sql else f"no sql, {df.count()} rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None and not problem.startswith("no sql")
        print(f"{time.time() - started:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
