"""Run registered queries on Spark and on DuckDB and compare the rows.

usage: python tools/check_oracle.py [--sf DIR] [--time] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from matchloom.session import local_session  # noqa: E402
from workload import load  # noqa: E402
from workload.registry import TABLES  # noqa: E402


def _kind(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r)))
    kinds = [sorted({_kind(r[i]) for r in data} - {"null"}) for i in range(len(names))]
    return names, kinds, data


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf, name, fn, sql, show=3):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    spark_time = time.time() - t0
    left = normalise(df.columns, rows)
    if sql is None:
        return ("ROWS", f"{len(rows)} rows", spark_time, 0.0)
    t0 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    right = normalise(cols, cur.fetchall())
    sql_time = time.time() - t0
    if left[0] != right[0]:
        return ("COLUMNS", f"{left[0]} != {right[0]}", spark_time, sql_time)
    if len(left[2]) != len(right[2]):
        only = [r for r in left[2] if r not in set(right[2])][:show]
        miss = [r for r in right[2] if r not in set(left[2])][:show]
        return ("COUNT", f"{len(left[2])} != {len(right[2])} extra={only} missing={miss}", spark_time, sql_time)
    if left[1] != right[1]:
        return ("TYPES", f"{list(zip(left[0], left[1], right[1]))}", spark_time, sql_time)
    bad = [(a, b) for a, b in zip(left[2], right[2]) if a != b]
    if bad:
        return ("VALUES", f"{len(bad)} of {len(left[2])} differ, e.g. {left[0]} {bad[:show]}", spark_time, sql_time)
    return ("ok", f"{len(rows)} rows", spark_time, sql_time)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    queries, oracle = load()
    spark, con = local_session("check"), duck(args.sf)
    failed = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            status, detail, a, b = compare(spark, con, args.sf, name, fn, oracle.get(name))
        except Exception as exc:  # noqa: BLE001
            status, detail, a, b = "ERROR", str(exc)[:900], 0, 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += status not in ("ok", "ROWS")
        print(f"{status:8s} {name:44s} {a:6.2f}s {b:6.2f}s  {detail}", flush=True)
    print(f"failed: {failed}")
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
