"""Run registered queries against their DuckDB oracles (the driver's gate).

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_compare import compare, duck_connect  # noqa: E402
from quarry.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = get_session(master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
spark.sparkContext.setLogLevel("ERROR")
qs, os_ = E.queries(), E.oracle_sql()
con = duck_connect(sf)
bad = 0
for name in (names or list(qs)):
    t = time.time()
    try:
        df = qs[name](spark, sf)
        if name in os_:
            ok, msg = compare(df, con, os_[name])
        else:
            n = df.count()
            ok, msg = True, f"rows-only: {n} rows"
    except Exception as e:  # noqa: BLE001
        ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:1500]}"
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {name:28s} {time.time()-t:6.2f}s  {msg}", flush=True)
print(f"{len(names or qs) - bad} ok, {bad} bad")
