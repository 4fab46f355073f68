"""Compare every registered query with its SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return "NULL" if value is None else str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs between a query's result and its SQL; empty if they agree."""
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return [f"columns {got[0]} instead of {want[0]}"]
    if got[1] == want[1]:
        return []
    out = [f"{len(got[1])} rows instead of {len(want[1])}"] if len(got[1]) != len(want[1]) else []
    a, b = set(got[1]), set(want[1])
    return out + [f"only Spark: {r}"[:600] for r in sorted(a - b)[:3]] + [f"only SQL: {r}"[:600] for r in sorted(b - a)[:3]]


def main() -> int:
    from txnlens.plans.oracle import ORACLE
    from txnlens.plans.registry import QUERIES
    from txnlens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            found = differences(df, con, ORACLE[name]) if name in ORACLE else [] if df.count() else ["no rows"]
        except Exception as e:  # report and go on with the next query
            found = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - begin:.1f}s", flush=True)
        for line in found:
            print("     ", line)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
