"""Batch run from the command line: load a survey, run the checks, write the deliverables.

    python -m fieldlens --input interviews.csv --output out/ [--format csv] [--profile batch]
                        [--settings country.json] [--set Timing.short_duration_min=15]
                        [--dates "dd/MM/yyyy HH:mm"] [--master local[8]]

Writes ``out/flagged`` (the flagged table), ``out/summary``, ``out/check_counts``,
``out/master_sheet``, ``out/master_narratives`` and ``out/error_logs/module=<m>``, then
prints the per-module flag rates.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import profile as P
from .functions.context import resolve_context
from .operators import deliver, monitor
from .plans.engine import run_checks
from .plans.materialize import RULE_JOB_CONF, session_conf
from .session import configure
from .sources.survey import load_survey, with_row_seq

PRESETS = {"batch": P.batch, "dashboard": P.dashboard}


def _modules(text: str) -> list[str]:
    return [m.strip() for m in text.split(",") if m.strip()]


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m fieldlens", description=__doc__.splitlines()[0])
    ap.add_argument("--input", "-i", required=True, help="where the interviews are: a path Spark can read")
    ap.add_argument("--output", "-o", required=True, help="folder for the result tables, replaced if it exists")
    ap.add_argument("--format", "-f", default="csv", help="how the interviews are stored: csv, parquet, orc or json")
    ap.add_argument("--profile", default="batch", choices=sorted(PRESETS), help="thresholds to start from")
    ap.add_argument("--settings", help="JSON file with thresholds, weights, columns or ranges to lay over the profile")
    ap.add_argument("--set", action="append", default=[], metavar="MODULE.KEY=VALUE", help="one threshold, after the file; may be repeated")
    ap.add_argument("--dates", action="append", default=[], metavar="PATTERN", help="date pattern of text columns, tried after ISO; may be repeated")
    ap.add_argument("--skip", default="", help="comma-separated modules not to check")
    ap.add_argument("--only", default="", help="comma-separated modules to check, none else")
    ap.add_argument("--id", default=None, help="unique key column giving the row order (else assigned)")
    ap.add_argument("--master", default=None, help="Spark master when no session exists")
    args = ap.parse_args(argv)

    builder = SparkSession.builder.appName("fieldlens").config("spark.ui.enabled", "false")
    if args.master:
        builder = builder.master(args.master)
    spark = configure(builder.getOrCreate())

    prof = PRESETS[args.profile]()
    if args.settings:
        text = "\n".join(r.value for r in spark.read.text(args.settings, wholetext=True).collect())  # any store
        prof = prof.with_settings(json.loads(text), name="settings")
    for one in args.set:
        prof = prof.with_overrides(P.parse_setting(one))
    prof = prof.select(only=_modules(args.only) or None, skip=_modules(args.skip))
    survey = with_row_seq(load_survey(spark, args.input, args.format, date_formats=args.dates, profile=prof), args.id)
    out = args.output.rstrip("/")
    # The flagged table is written first; every deliverable is then read from it.
    with session_conf(spark, RULE_JOB_CONF):
        run_checks(survey, prof).write.mode("overwrite").parquet(f"{out}/flagged")
    flagged = spark.read.parquet(f"{out}/flagged")
    deliver.write_deliverables(flagged, resolve_context(flagged.columns, "report"), out, prof)

    for r in monitor.module_summary(flagged).collect():  # one row a module
        print(f"{r.module}: {r.flagged_records} of {r.total_records} interviews flagged ({r.flag_rate_pct or 0:.1f} %)")
    print(f"tables written to {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
