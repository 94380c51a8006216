"""Compare every registered query against its DuckDB oracle: python tests/run_oracle.py [sf_dir] [names...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from quantloom.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = build_session("local[8]", 8)
con = duck(sf)
qs, sqls = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if names and name not in names:
        continue
    t0 = time.time()
    if name not in sqls:
        try:
            n = fn(spark, sf).count()
            print(f"ROWS {name}: {n} rows ({time.time()-t0:.1f}s)")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:400]}")
        continue
    try:
        n, problems = compare(spark, con, name, fn, sqls[name], sf)
    except Exception as e:  # noqa: BLE001
        n, problems = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
    status = "OK  " if not problems else "FAIL"
    bad += bool(problems)
    print(f"{status} {name}: {n} rows ({time.time()-t0:.1f}s) {'; '.join(problems)}")
print("failures:", bad)
