"""Compare Spark result types with DuckDB oracle types for every oracled query.

usage: python tests/run_typecheck.py [sf_dir]
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_compare import duck_connect, type_diff  # noqa: E402
from quarry.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = get_session(master="local[8]", shuffle_partitions=8)
spark.sparkContext.setLogLevel("ERROR")
qs, oracles = E.queries(), E.oracle_sql()
con = duck_connect(sf)
bad = 0
for name, sql in oracles.items():
    diff = type_diff(qs[name](spark, sf), con, sql)
    if diff:
        bad += 1
        print(f"TYPE {name}: {diff}", flush=True)
print(f"{len(oracles) - bad} same, {bad} differ")
