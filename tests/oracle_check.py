"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from flipside.session import build_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 4)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = build_session(8)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SPARK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in os_:
            print(f"{name:34s} rows={len(rows):6d} (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            res = con.execute(os_[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:34s} SQL-ERROR {str(e)[:400]}")
            bad += 1
            continue
        to = time.time() - t1
        same_cols = sorted(cols) == sorted(ocols)
        a, b = canon(cols, rows), canon(ocols, orows)
        ok = same_cols and a == b
        bad += not ok
        print(f"{name:34s} {'OK  ' if ok else 'DIFF'} rows={len(rows)}/{len(orows)} spark={ts:.1f}s sql={to:.1f}s"
              + ("" if same_cols else f" cols {sorted(cols)} vs {sorted(ocols)}"))
        if not ok and same_cols:
            sa, sb = set(a), set(b)
            for r in list(sa - sb)[:2]:
                print("   spark-only:", repr(r)[:400])
            for r in list(sb - sa)[:2]:
                print("   sql-only:  ", repr(r)[:400])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
