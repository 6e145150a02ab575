"""Run queries against their twins from the command line: python tests/check.py [folder] [name prefix ...]"""

import os
import sys
import time

sys.path.insert(0, ".")

from sessionloom.session import build_session
from tests.oracle import compare

from __spark_entry__ import oracle_sql, queries

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("ROWS_PER_SLICE"):
        spark.conf.set("sessionloom.rowsPerSlice", os.environ["ROWS_PER_SLICE"])
    bad = 0
    for name in queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            rows = compare(spark, name, folder)
            print(f"ok   {name:28s} {rows:8d} rows {time.time() - begin:6.2f}s {'' if name in oracle_sql() else '(no twin)'}", flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL {name:28s} {str(error)[:1500]}", flush=True)
    print("failed:", bad)
