"""Run registered queries next to their SQL in DuckDB and compare whole results.

    python tests/oracle_check.py [--sf 0.01] [--chunk N] [name prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return value
    return value


def compare(spark_rows, spark_cols, sql_rows, sql_cols) -> str:
    """Empty string when equal, else the difference."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} != {sorted(sql_cols)}"
    order = sorted(spark_cols)
    si, qi = [spark_cols.index(c) for c in order], [sql_cols.index(c) for c in order]
    left = Counter(tuple(_plain(r[i]) for i in si) for r in spark_rows)
    right = Counter(tuple(_plain(r[i]) for i in qi) for r in sql_rows)
    if left == right:
        return ""
    a, b = left - right, right - left
    return (f"rows {sum(left.values())} vs {sum(right.values())}; only spark {sum(a.values())}, only sql "
            f"{sum(b.values())}\n  {order}\n  spark {list(a)[:3]}\n  sql   {list(b)[:3]}")


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--chunk", type=int)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from clipline.operators import ordered
    from clipline.session import build_session

    if args.chunk:
        ordered.ROWS_PER_CHUNK = args.chunk
        ordered.CHUNKS = max(100, 3000 // args.chunk)
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        began = time.time()
        try:
            frame = query(spark, sf_dir)
            rows, cols = [tuple(r) for r in frame.collect()], frame.columns
            took = time.time() - began
            if name not in sqls:
                print(f"rows {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            cursor = con.execute(sqls[name])
            result = compare(rows, cols, cursor.fetchall(), [c[0] for c in cursor.description])
        except Exception as error:  # report and go on with the next query
            result, took, rows = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - began, []
        bad += bool(result)
        print(f"{'ok  ' if not result else 'FAIL'} {name} {len(rows)} {took:.1f}s {result}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
