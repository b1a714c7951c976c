"""Named queries over the driver's test tables (one per operator of SURVEY §2).

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame.  All of them
read the whole ``events`` table, derive the survey from it, run the checks
(materialized once per input and code version) and apply one operator.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P
from ..functions.context import resolve_context
from ..operators import deliver as D
from ..operators import facts as A
from ..operators import monitor as M
from ..sources.fixture import events_path, survey_from_events
from ..session import checkpoint_dir
from ..sources.ingest import ingest, ingested
from ..sources.survey import coerce_types, preview, spread
from ..streaming.incremental import aggregate_files
from ..streaming.running import RunningFacts
from .engine import module_view, run_checks
from .materialize import RULE_JOB_CONF, code_version, exists, input_fingerprint, materialize, session_conf

# Parameter of the progress queries: the planned number of interviews.
SAMPLE_TARGET = 12_000


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_from_events(spark.read.parquet(events_path(sf_dir)))


def spread_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey in tasks of a bounded number of rows: the narrow events are dealt, not the wide rows."""
    return survey_from_events(spread(spark.read.parquet(events_path(sf_dir))))


def flagged(spark: SparkSession, sf_dir: str, prof: P.Profile | None = None, rebuild: bool = False) -> DataFrame:
    """The flagged survey of ``sf_dir``: written once by a job of its own, then a lazy scan.

    The key holds the input's files, the rules' sources and every value of the profile."""
    prof = prof or P.fixture()
    key = f"flagged-{prof.name}-{prof.fingerprint()}-{input_fingerprint(spark, [events_path(sf_dir)])}-{code_version()}"
    return materialize(spark, lambda: run_checks(spread_survey(spark, sf_dir), prof), key, rebuild=rebuild)


def flagged_from(spark: SparkSession, survey_df: DataFrame, name: str, prof: P.Profile | None = None) -> DataFrame:
    """Flag any survey DataFrame once (materialized under ``name`` + code version)."""
    prof = prof or P.fixture()
    return materialize(spark, lambda: run_checks(survey_df, prof), f"{name}-{prof.name}-{prof.fingerprint()}-{code_version()}",
                       rebuild=True)


def _dash(df: DataFrame):
    return resolve_context(_survey_columns(df), "dashboard")


def _report(df: DataFrame):
    return resolve_context(_survey_columns(df), "report")


def _survey_columns(df: DataFrame) -> list[str]:
    """The columns a context is looked for in; the facts table names a date by its day."""
    return [c.removeprefix(A.DAY) for c in df.columns]


def facts(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> DataFrame:
    """The partial-aggregate table of the flagged survey, written once from one scan of it."""
    prof = P.fixture()
    key = f"facts-{prof.name}-{prof.fingerprint()}-{input_fingerprint(spark, [events_path(sf_dir)])}-{code_version()}"

    def build() -> DataFrame:
        f = flagged(spark, sf_dir)
        return A.build(f, _dash(f), _report(f))

    return materialize(spark, build, key, rebuild=rebuild)


def streamed_facts(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The same table kept by a file stream over the flagged table, batch by batch."""
    f = flagged(spark, sf_dir)
    source = f._fieldlens_path
    state = RunningFacts(f"{checkpoint_dir(spark).rstrip('/')}/fieldlens/running-{source.rsplit('/', 1)[1]}-{files_per_batch}", _dash(f), _report(f))
    query = aggregate_files(spark, source, f.schema, state, "registry", files_per_batch=files_per_batch)
    query.awaitTermination()
    return state.read(spark)


def _with_stream(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(streamed_facts(spark, sf_dir)))
    return run


def portable(df: DataFrame) -> DataFrame:
    """Outputs compared across engines: dates as ISO text, nullable flags as DOUBLE."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.IntegerType) and f.name.startswith("Flag_"):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def _with_flagged(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(flagged(spark, sf_dir)))
    return run


def _with_facts(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(facts(spark, sf_dir)))
    return run


def _module_flags(module: str) -> Callable[[DataFrame], DataFrame]:
    """Slice 1-2: id, row order, derived scores and flags (narrative left to the error log)."""
    def q(f: DataFrame) -> DataFrame:
        view = module_view(f, module, P.fixture())
        keep = [c for c in view.columns
                if c in ("_uuid", "row_seq") or (not c.startswith("Flag_") and c not in P.CONTEXT_COLUMNS)
                or (c.startswith("Flag_") and not c.endswith("_Narrative"))]
        return view.select(*[F.col(f"`{c}`") for c in keep])
    return q


def _fcs_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FCS module only under the dashboard preset (high > 100, staple < 2); narrow and lazy."""
    f = run_checks(spread_survey(spark, sf_dir), P.dashboard(), only=["FCS"])
    return portable(f.select("_uuid", "row_seq", "FCS", "FCG", "Flag_FCS_Missing", "Flag_FCS_Erroneous", "Flag_FCS_Identical",
                    "Flag_FCS_LowStaple", "Flag_FCS_Low", "Flag_FCS_High", "Flag_FCS_Overall"))


def _fcs_own_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FCS and rCSI under a country profile: two weights changed, the higher cut-offs 28 and 42."""
    prof = P.fixture().with_settings({
        "fcs_weights": {**P.FCS_WEIGHTS, "FCSSugar": 0.25, "FCSPr": 3.5},
        "thresholds": {"FCS": {"fcg_poor_threshold": 28, "fcg_borderline_threshold": 42}}}, name="own-weights")
    f = run_checks(spread_survey(spark, sf_dir), prof, only=["FCS", "rCSI"])
    return portable(f.select("_uuid", "row_seq", "FCS", "FCG", "Flag_FCS_Low", "Flag_FCS_High", "Flag_FCS_Overall",
                             "Flag_rCSI_ZeroWithPoorFCG", "Flag_rCSI_HighWithAcceptFCG"))


def _as_text(typed: DataFrame) -> DataFrame:
    """A survey written out as text, days before months."""
    return typed.select(*[F.date_format(f"`{f.name}`", SHOWN[type(f.dataType)]).alias(f.name) if type(f.dataType) in SHOWN
                          else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in typed.schema.fields])


SHOWN = {T.TimestampType: "dd/MM/yyyy HH:mm:ss.SSSSSS", T.TimestampNTZType: "dd/MM/yyyy HH:mm:ss.SSSSSS", T.DateType: "dd/MM/yyyy"}


def _checks_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of three modules written out as text, coerced back and checked."""
    typed = spread_survey(spark, sf_dir)
    used = {*P.CONTEXT_COLUMNS, "_uuid", "row_seq", *[x.name for g in (P.DEMO_SPECS, P.FCS_SPECS, P.TIMING_SPECS) for x in g]}
    text = _as_text(typed.select(*[c for c in typed.columns if c in used]))
    f = run_checks(coerce_types(text, date_formats=list(dict.fromkeys(SHOWN.values()))), P.fixture(), only=["Demo", "FCS", "Timing"])
    return portable(f.select(F.col("_uuid").cast("long").alias("_uuid"), F.col("row_seq").cast("long").alias("row_seq"), "today", "HHSize", "FCS",
                             "Timing_Duration_Min", "Flag_Demo_Overall", "Flag_FCS_Overall", "Flag_Timing_Overall"))


# Texts put into every m-th row (at remainder r) of a column before it is read
# again.  Blanks are missing answers.
UNREADABLE = {"HHSize": (97, 5, "many"), "FCSStap": (89, 3, "5d"), "today": (83, 7, "31/31/2024"), "start": (101, 9, "soon"), "rCSIBorrow": (79, 2, "  ")}


# A moment is written as one number, not as the older 12-byte text of days and nanoseconds.
INGEST_CONF = {**RULE_JOB_CONF, "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}


def ingested_text(spark: SparkSession, sf_dir: str):
    """The survey as text with unreadable answers, ingested once for all queries that ask about it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/fieldlens/ingest-{input_fingerprint(spark, [events_path(sf_dir)])}-{code_version()}"
    if not exists(spark, f"{path}/report/_SUCCESS"):
        text = _as_text(spread_survey(spark, sf_dir)).withColumns({"row_seq": F.col("row_seq").cast("long")})
        hurt = text.withColumns({c: F.when(F.col("row_seq") % m == r, bad).otherwise(F.col(c)) for c, (m, r, bad) in UNREADABLE.items()})
        with session_conf(spark, INGEST_CONF):
            ingest(spark, hurt, path, date_formats=list(dict.fromkeys(SHOWN.values())))
    return ingested(spark, path)


def _clashing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8 + B9: an input column named like a score is kept aside; only two modules run."""
    f = run_checks(spread_survey(spark, sf_dir).withColumn("FCS", F.col("row_seq") * 2.0), P.fixture(), only=["FCS", "HDDS"])
    ran = F.lit(",".join(m for m in P.MODULE_ORDER if f"Flag_{m}_Overall" in f.columns))
    return portable(f.select("row_seq", "FCS", "FCS_input", "Flag_FCS_Overall", "Flag_HDDS_Overall", ran.alias("modules")))


def _written(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A sink writes into a new folder of the shared checkpoint folder; its files are read back."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(spark, flagged(spark, sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/fieldlens-written/{uuid.uuid4().hex}"))
    return run


def _written_master(spark: SparkSession, f: DataFrame, path: str) -> DataFrame:
    D.write_deliverables(f, _report(f), path, P.fixture())
    return spark.read.parquet(f"{path}/master_sheet")


def _written_logs(spark: SparkSession, f: DataFrame, path: str) -> DataFrame:
    D.write_error_logs(f, path, P.fixture())
    counts = [spark.read.parquet(f"{path}/module={m}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("module"), "n") for m in P.MODULE_ORDER]
    return reduce(DataFrame.unionByName, counts)


def _written_feedback(spark: SparkSession, f: DataFrame, path: str) -> DataFrame:
    D.write_enumerator_feedback(f, _report(f), path)
    return spark.read.parquet(f"{path}/rows").groupBy(F.col("EnuName").alias("enumerator")).agg(F.count(F.lit(1)).alias("n"))


def _error_log(module: str) -> Callable[[DataFrame], DataFrame]:
    return lambda f: D.error_log(f, module, P.fixture())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

for _m in P.MODULE_ORDER:
    QUERIES[f"{_m.lower()}_flags"] = _with_flagged(_module_flags(_m))
QUERIES["fcs_flags_dashboard"] = _fcs_dashboard
QUERIES["fcs_own_weights"] = _fcs_own_weights
QUERIES.update({
    # slice 1 / 3: summaries
    "fcs_summary": _with_facts(lambda f: A.check_counts(f).where(F.col("module") == "FCS")),
    "module_summary": _with_facts(A.module_summary),
    "check_counts": _with_facts(A.check_counts),
    "top_checks": _with_facts(A.top_checks),
    "flagged_ids": _with_flagged(lambda f: M.flagged_ids(f, _report(f))),
    "flag_rate_by_enumerator": _with_flagged(lambda f: M.flag_rate_by_enumerator(f, _report(f))),
    "flag_rate_by_area": _with_flagged(lambda f: M.flag_rate_by_area(f, _report(f))),
    "survey_header": _with_facts(lambda f: A.survey_header(f, _report(f))),
    "daily_counts_cumulative": _with_facts(lambda f: A.daily_counts(f, _report(f), SAMPLE_TARGET)),
    "fcg_dist": _with_facts(A.fcg_dist),
    "rcsi_dist": _with_facts(A.rcsi_dist),
    "hdds_dist": _with_facts(A.hdds_dist),
    "lcs_tier_dist": _with_facts(A.lcs_tier_dist),
    "score_means": _with_facts(A.score_means),
    "duration_stats": _with_flagged(M.duration_stats),
    # slice 4: behaviour
    "surveys_by_area": _with_facts(lambda f: A.surveys_per(f, _dash(f).area, "area")),
    "duplicate_ids": _with_flagged(lambda f: M.duplicate_ids(f, _dash(f))),
    "duplicate_rows": _with_flagged(lambda f: M.duplicate_rows(f, _dash(f))),
    "straight_lining": _with_facts(lambda f: A.straight_lining(f, _dash(f))),
    "missing_pct_by_enumerator": _with_facts(lambda f: A.missing_pct_by_enumerator(f, _dash(f))),
    "valid_duration_by_enumerator": _with_facts(lambda f: A.valid_duration_by_enumerator(f, _dash(f))),
    "enumerator_scorecard": _with_flagged(  # straight_line is NULL for enumerators without any
        lambda f: M.enumerator_scorecard(f, _dash(f)).withColumn("straight_line", F.col("straight_line").cast("double"))),
    "enumerator_deviation": _with_facts(lambda f: A.enumerator_deviation(f, _dash(f))),
    "submission_matrix": _with_facts(lambda f: A.submission_matrix(f, _dash(f))),
    # slice 5: breakdowns
    "fcg_share_by_area": _with_facts(lambda f: A.fcg_share(f, _dash(f).area)),
    "rcsi_share_by_enumerator": _with_facts(lambda f: A.rcsi_share(f, _dash(f).enu)),
    "fcg_share_top_areas": _with_facts(lambda f: A.fcg_share(f, _dash(f).area, top_n=3)),
    "fcg_share_by_enumerator": _with_facts(lambda f: A.fcg_share(f, _dash(f).enu)),
    "rcsi_share_by_area": _with_facts(lambda f: A.rcsi_share(f, _dash(f).area)),
    "behaviour_totals": _with_facts(A.behaviour_totals),
    "hdds_mean_by_area": _with_facts(lambda f: A.mean_by(f, _dash(f).area, "HDDS")),
    "score_trend": _with_facts(lambda f: A.score_trend(f, _dash(f))),
    "lcs_response_dist": _with_facts(A.lcs_response_dist),
    "lcs_na_rate": _with_facts(lambda f: A.lcs_na_rate(f, _dash(f))),
    "five_number_by_group": _with_flagged(lambda f: M.five_number(f, _dash(f).enu, "Timing_Duration_Min")),
    "fcs_box_by_area": _with_flagged(lambda f: M.five_number(f, _dash(f).area, "FCS")),
    "box_outliers": _with_flagged(lambda f: M.box_outliers(f, _dash(f).enu, "Timing_Duration_Min", _dash(f).hhid)),
    "rcsi_box_by_area": _with_flagged(lambda f: M.five_number(f, M.score_box_group(_dash(f)), "rCSI")),
    "fcs_outliers_by_area": _with_flagged(lambda f: M.box_outliers(f, M.score_box_group(_dash(f)), "FCS", _dash(f).hhid)),
    "rcsi_outliers_by_area": _with_flagged(lambda f: M.box_outliers(f, M.score_box_group(_dash(f)), "rCSI", _dash(f).hhid)),
    "tukey_outliers": _with_flagged(M.tukey_outliers),
    "start_hour_hist": _with_facts(lambda f: A.start_hour_hist(f, _dash(f))),
    "score_hist": _with_flagged(M.score_hist),
    "consistency_matrix": _with_facts(A.consistency_matrix),
    "expenditure_extremes": _with_flagged(M.expenditure_extremes),
    "missing_rate_matrix": _with_facts(lambda f: A.missing_rate_matrix(f, _dash(f))),
    # slice 6: deliverables
    "master_sheet": _with_flagged(lambda f: D.master_sheet(f, _report(f))),
    "master_narratives": _with_flagged(lambda f: D.master_narratives(f, _report(f))),
    "enumerator_feedback": _with_facts(lambda f: A.enumerator_feedback(f, _dash(f))),
    "top_enumerators": _with_flagged(lambda f: D.top_enumerators(f, _report(f))),
    "issue_ranking": _with_flagged(D.issue_ranking),
    "priority_alerts": _with_flagged(lambda f: D.priority_alerts(f, _dash(f), _report(f))),
    "recommendations": _with_flagged(lambda f: D.recommendations(f, _report(f))),
    "progress": _with_facts(lambda f: A.progress(f, _report(f), SAMPLE_TARGET)),
    "enumerator_completion": _with_facts(lambda f: A.enumerator_completion(f, _dash(f), SAMPLE_TARGET)),
    "area_completion": _with_facts(lambda f: A.area_completion(f, _dash(f), SAMPLE_TARGET)),
    # sinks read back, display form
    "written_master_sheet": _written(_written_master),
    "written_error_logs": _written(_written_logs),
    "written_feedback_rows": _written(_written_feedback),
    "enumerators_displayed": _with_flagged(lambda f: D.present(M.flag_rate_by_enumerator(f, _report(f)).select(
        "enumerator", "surveys", "rate_pct", "survey_share_pct"))),
    # tables of a file stream, as of its last batch
    "stream_daily_counts": _with_stream(lambda f: A.daily_counts(f, _report(f), SAMPLE_TARGET)),
    "stream_score_trend": _with_stream(lambda f: A.score_trend(f, _dash(f))),
    "stream_progress": _with_stream(lambda f: A.progress(f, _report(f), SAMPLE_TARGET)),
    # sources
    "checks_from_text": _checks_from_text,
    "clashing_input": _clashing_input,
    "survey_shape": lambda spark, sf: ingested_text(spark, sf).shape(),
    "ingest_report": lambda spark, sf: ingested_text(spark, sf).warnings(),
    "unparsed_values": lambda spark, sf: ingested_text(spark, sf).unparsed("row_seq"),
    "survey_preview": lambda spark, sf: portable(
        preview(survey(spark, sf).select("_uuid", "row_seq", "EnuName", "today", "FCSStap"))),
})
for _m in P.MODULE_ORDER:
    QUERIES[f"error_log_{_m.lower()}"] = _with_flagged(_error_log(_m))
