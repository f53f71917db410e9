"""python tests/check_queries.py [folder] [key part]...: every query against its SQL, with times."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from sendero.plans.session import local_session  # noqa: E402
from tests.oracle import connect, duck_rows, spark_rows, types  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = local_session("check")
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
oracles = entry.oracle_sql()
bad = 0
for key, run in entry.queries().items():
    if wanted and not any(w in key for w in wanted):
        continue
    start = time.time()
    try:
        df = run(spark, folder)
        mine = spark_rows(df)
        took = time.time() - start
        if key not in oracles:
            print(f"\nrows  {key} {took:.1f}s n={len(mine[1])}", flush=True)
            continue
        start = time.time()
        theirs = duck_rows(con, oracles[key])
        duck = time.time() - start
        off = types(df, con, oracles[key])
        if mine == theirs:
            print(f"\nok    {key} {took:.1f}s duck {duck:.1f}s n={len(mine[1])} {'TYPES ' + str(off) if off else ''}", flush=True)
        else:
            bad += 1
            diff = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b][:3]
            print(f"\nDIFF  {key} {mine[0]} {theirs[0]} n={len(mine[1])}/{len(theirs[1])} {str(diff)[:900]}", flush=True)
    except Exception as error:  # report and go on
        bad += 1
        print(f"\nERROR {key} {str(error)[:700]}", flush=True)
print("bad", bad)
