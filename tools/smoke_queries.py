"""Run every registered query once and print rows / seconds (local check tool)."""
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from fieldlens.plans.registry import QUERIES  # noqa: E402
from fieldlens.session import local_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2:])
spark = local_session(8)
for name, fn in QUERIES.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        rows = fn(spark, sf_dir).collect()
        print(f"{name:32s} rows={len(rows):6d} {time.time() - t:6.2f}s", flush=True)
    except Exception as exc:  # report and continue
        print(f"{name:32s} FAILED {type(exc).__name__}: {str(exc).splitlines()[0][:200]}", flush=True)
