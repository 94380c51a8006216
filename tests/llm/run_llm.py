"""python tests/llm/run_llm.py [sf_dir] [names...]: run the training-data queries, against SQL where there is some."""
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from oracle import compare, duck  # noqa: E402
from quantloom.llm.queries import QUERIES, SQL  # noqa: E402
from quantloom.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark, con = build_session("local[8]", 8), duck(sf)
for name in sys.argv[2:] or QUERIES:
    t0 = time.time()
    if name in SQL:
        n, problems = compare(spark, con, name, QUERIES[name], SQL[name], sf)
        print("FAIL" if problems else "OK  ", name, n, f"{time.time() - t0:.1f}s", *[str(p)[:900] for p in problems])
    else:
        df = QUERIES[name](spark, sf).toPandas()
        print("ROWS", name, len(df), f"{time.time() - t0:.1f}s")
        print(df.head(4).to_string(max_colwidth=60))
spark.stop()
