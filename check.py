"""Run every registered query against its DuckDB oracle (local gate).

usage: python check.py [sf_dir] [name-substring ...]
"""
import json
import sys
import time

from caravan.plans.oracle_check import compare, duck_conn
from caravan.plans.registry import QUERIES, _load_all
from caravan.session import build_session


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    _load_all()
    con = duck_conn(sf)
    bad = 0
    for name, (fn, sql) in QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            r = compare(spark, name, fn, sql, sf, con)
        except Exception as e:  # report and go on
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        r["sec"] = round(time.time() - t0, 2)
        if r.get("match") is False or "error" in r:
            bad += 1
        print(json.dumps(r, default=str), flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")


if __name__ == "__main__":
    main()
