"""Benchmark: build the flagged survey once, then run every registered query.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8).  Prints one JSON line on stdout:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldlens.plans.registry import QUERIES, facts, flagged  # noqa: E402
from fieldlens.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="fieldlens-bench")
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    # run_checks over the whole survey, written as Parquet in the session's checkpoint
    # folder; rebuilt here even if an earlier run left one, so the build is timed.
    flagged(spark, sf_dir, rebuild=True)
    times["flag_table"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    facts(spark, sf_dir, rebuild=True)  # one scan of it, for the queries that read aggregates alone
    times["facts_table"] = round(time.perf_counter() - t0, 3)
    for name, fn in QUERIES.items():
        t = time.perf_counter()
        fn(spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "flag_table_plus_all_queries_wall",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
