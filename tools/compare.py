"""Run registered queries and their comparison SQL on one data folder and report differences.

    python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "∅"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6f}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return len(got[1]), None, t1 - t0, 0.0
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problems = []
    if got[0] != want[0]:
        problems.append(f"columns {got[0]} != {want[0]}")
    if got[1] != want[1]:
        from collections import Counter

        a, b = Counter(got[1]), Counter(want[1])
        problems.append(f"rows {len(got[1])} vs {len(want[1])}; only here {list((a - b))[:2]}; only there {list((b - a))[:2]}")
    return len(got[1]), problems, t1 - t0, t2 - t1


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from sparkwarden.plans.all_queries import ORACLES, QUERIES
    from sparkwarden.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            n, problems, ts, td = compare(spark, con, name, fn, ORACLES.get(name), args.sf)
            state = "rows only" if problems is None else ("ok" if not problems else "DIFFERS")
        except Exception as error:  # report and go on with the next query
            n, problems, ts, td, state = -1, [str(error)[:1500]], 0, 0, "ERROR"
        bad += state in ("DIFFERS", "ERROR")
        print(f"\n@@ {name:32s} {state:9s} rows={n:<7d} spark={ts:5.1f}s sql={td:5.1f}s", flush=True)
        for p in problems or []:
            print("@@    ", p[:1800], flush=True)
    print(f"\n@@ {bad} bad of {len(QUERIES)}")


if __name__ == "__main__":
    main()
