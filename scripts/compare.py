"""Run registered queries on Spark and their SQL on DuckDB, and compare all values.

usage: python scripts/compare.py [--sf 0.01] [--only PREFIX,...] [--plans]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from diffgauge.plans.registry import load  # noqa: E402
from diffgauge.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.10g}"))
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=repr), [columns[i] for i in order]


def compare(plan, sql, spark, con, folder):
    df = plan(spark, folder)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only ({len(got)})", True, len(got)
    cur = con.execute(sql)
    want, names = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != names:
        return f"columns differ: {cols} / {names}", False, len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 300000 else []
        return f"rows differ: {len(got)} / {len(want)} e.g. {extra} / {[r for r in want if r not in set(got)][:2]}", False, len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {str(bad[0][0])[:600]} / {str(bad[0][1])[:600]}", False, len(got)
    return "equal", True, len(got)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session(8, memory="12g")
    con = connect(folder)
    plans, oracles = load()
    only = [p for p in args.only.split(",") if p]
    failed = []
    for name, plan in plans.items():
        if only and not any(name.startswith(p) for p in only):
            continue
        t = time.time()
        try:
            text, ok, n = compare(plan, oracles.get(name), spark, con, folder)
        except Exception as e:      # a broken query must not hide the others
            text, ok, n = f"{type(e).__name__}: {str(e)[:700]}", False, -1
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {n:8d} rows {time.time() - t:7.2f}s  {text}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
