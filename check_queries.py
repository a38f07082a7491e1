"""Run queries beside their SQL checks: python check_queries.py [--sf DIR] [names or prefixes…]"""
from __future__ import annotations

import argparse
import datetime
import decimal
import math
import time

import duckdb

from tagloom.plans import load
from tagloom.session import local_session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (decimal.Decimal, float)):
        return float(value)
    if isinstance(value, int):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cores", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    reg = load()
    spark = local_session(args.cores)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    for name, fn in reg.QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in reg.CHECKS:
                print(f"rows  {name:45s} {len(got):7d} rows {took:6.2f}s", flush=True)
                continue
            res = con.execute(reg.CHECKS[name])
            cols = [d[0] for d in res.description]
            want = rows_of(cols, res.fetchall())
            if sorted(cols) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(cols)}", flush=True)
            elif got != want:
                bad += 1
                print(f"DIFF  {name}: {len(got)} vs {len(want)} rows", flush=True)
                gs, ws = set(map(repr, got)), set(map(repr, want))
                for r in sorted(gs - ws)[:3]:
                    print("   spark ", r[:400])
                for r in sorted(ws - gs)[:3]:
                    print("   check ", r[:400])
            else:
                mark = "" if got else "  EMPTY"
                print(f"ok    {name:45s} {len(got):7d} rows {took:6.2f}s{mark}", flush=True)
        except Exception as error:  # a broken query must not hide the others
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:900]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
