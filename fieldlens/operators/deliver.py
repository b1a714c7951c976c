"""Deliverable tables and sinks.

Tables are lazy DataFrames; ``write_*`` functions are the sinks.  Written
outputs are partitioned by module / enumerator so field teams read only
their slice.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions.context import Context
from ..functions import columns as R
from ..functions.columns import col
from ..plans.engine import any_flag, module_view, modules_in
from ..plans.materialize import seen, written
from . import monitor as M

# Context columns of the master sheet.
MASTER_BASE = ("_uuid", "EnuName", "EnuSupervisorName", "ADMIN1Name", "ADMIN2Name", "today")


# -- A5: per-module error log -------------------------------------------------------

def error_log(flagged: DataFrame, module: str, profile: P.Profile | None = None) -> DataFrame:
    """Flagged rows of one module with its context, derived and flag columns."""
    view = module_view(flagged, module, profile)
    return view.where(col(f"Flag_{module}_Overall") == 1)


def write_error_logs(flagged: DataFrame, path: str, profile: P.Profile | None = None, fmt: str = "parquet") -> None:
    """A5/A6 sink: one folder per module (``module=<m>/``); a module with no flag
    writes an empty table with its header, which is the 'no flags' message."""
    for m in modules_in(flagged):
        error_log(flagged, m, profile).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE) \
            .format(fmt).save(f"{path.rstrip('/')}/module={m}")


# -- H3: master sheet ---------------------------------------------------------------

def _row_narrative(flagged: DataFrame) -> Column:
    """All raised module narratives of the row, '[module] text', joined by ' || '."""
    parts = [F.when(col(f"Flag_{m}_Overall") == 1, F.concat(F.lit(f"[{m}] "), col(f"Flag_{m}_Narrative")))
             for m in modules_in(flagged)]
    return F.concat_ws(" || ", *parts)


def master_narratives(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Long form of the master narrative: one row per (flagged row, flagged module).

    Ordering by (module_pos, row_seq) within an id reproduces the joined text of
    the workbook; nothing is collected per id, so a hot id stays distributed.
    """
    idc = col(ctx.hhid)
    mods = modules_in(flagged)
    stack = ", ".join(f"'{m}', {i}, `Flag_{m}_Overall`, `Flag_{m}_Narrative`" for i, m in enumerate(mods))
    long = flagged.where(idc.isNotNull()).select(
        idc.alias("id"), "row_seq", F.expr(f"stack({len(mods)}, {stack}) AS (module, module_pos, overall, text)"))
    return long.where(F.col("overall") == 1).select("id", "module", "module_pos", "row_seq", "text")


def master_sheet(flagged: DataFrame, ctx: Context) -> DataFrame:
    """H3: one row per input row whose id is flagged in any module.

    ``<module>_Flag`` / ``<module>_Issues`` come from the last row (highest ``row_seq``)
    with that id.  ``Flag_All_Narrative`` is the row's own text; the complete text of an id
    is the rows of ``master_narratives`` (repeating it on each of an id's k rows would
    write k x k texts).

    Ids are aggregated to two numbers, and only the last row of a flagged id carries texts.
    Both joins have plain exchanges on both sides, so a hot id can be split by AQE.
    """
    idc = ctx.hhid
    mods = modules_in(flagged)
    ids = flagged.where(col(idc).isNotNull()).groupBy(col(idc).alias("_id")).agg(
        F.max("row_seq").alias("_last"), F.max(any_flag(flagged)).alias("_idf")).where(F.col("_idf") == 1)
    issues = [x for m in mods for x in (col(f"Flag_{m}_Overall").alias(f"{m}_Flag"), col(f"Flag_{m}_Narrative").alias(f"{m}_Issues"))]
    last = flagged.select(col(idc).alias("_of"), F.col("row_seq").alias("_at"), *issues) \
        .join(ids, (F.col("_of") == F.col("_id")) & (F.col("_at") == F.col("_last"))).drop("_of", "_at", "_last", "_idf")
    base = [c for c in MASTER_BASE if c in flagged.columns]
    rows = flagged.select(*dict.fromkeys([*base, idc, "row_seq"]), _row_narrative(flagged).alias("Flag_All_Narrative"))
    return rows.join(last, col(idc) == F.col("_id"), "inner").select(
        *[col(c) for c in base], "row_seq", "Flag_All_Narrative", *[c for m in mods for c in (f"{m}_Flag", f"{m}_Issues")])


# -- A7 / G33: enumerator feedback ---------------------------------------------------

def enumerator_feedback(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Rows and flagged rows per enumerator (row semantics), rate desc."""
    enu = ctx.enu
    out = (flagged.where(col(enu).isNotNull()).groupBy(col(enu).alias("enumerator"))
           .agg(F.count(F.lit(1)).alias("total_surveys"), F.count_if(any_flag(flagged) == 1).alias("flagged_records")))
    return out.withColumn("flag_rate_pct", F.col("flagged_records") / F.col("total_surveys") * 100.0) \
        .orderBy(F.desc("flag_rate_pct"), "enumerator")


#: Rows in a written file.
ROWS_PER_FILE = 1_000_000
#: Rows of a writer task's part of a key: a sink with a folder a key sorts the wide rows of a task.
ROWS_PER_TASK = 100_000


def spread_by_key(rows: DataFrame, key: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``rows`` clustered for a sink with one folder a key: each key's rows are counted, a key
    of more than ``ROWS_PER_TASK`` rows (or a file's) is dealt to several tasks by a hash of the row.

    The keys, one row each, are laid end to end; a task gets the parts that begin in its
    stretch of that line.  So it holds at most two tasks' worth of rows however many rows a
    key has, and neither that nor the size of the files follows from the input's files."""
    most = min(rows_per_file, ROWS_PER_TASK)
    counts = rows.groupBy(col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(counts.select("_key", F.ceil(F.col("_n") / most).alias("_parts"), "_n", before.alias("_start")),
                    "sink-keys", keys="count(1)", rows="sum(_n)")
    few = seen(sizes)["keys"] <= M.BROADCAST_GROUPS
    spot = F.xxhash64("row_seq") if "row_seq" in rows.columns else F.xxhash64(*[col(c) for c in rows.columns])
    part = F.pmod(spot, F.col("_parts"))
    task = F.expr(f"CAST((_start + (_part * _n) div _parts) div {most} AS INT)")
    return rows.join(F.broadcast(sizes) if few else sizes, col(key) == F.col("_key")).withColumn("_part", part) \
        .withColumn("_task", task).repartitionById(-(-(seen(sizes)["rows"] or 0) // most) or 1, F.col("_task")).drop("_key", "_parts", "_n", "_start", "_part", "_task")


def write_enumerator_feedback(flagged: DataFrame, ctx: Context, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """A7 sink: summary table plus flagged rows partitioned by enumerator, in files of at most
    ``rows_per_file`` rows."""
    root = path.rstrip("/")
    enumerator_feedback(flagged, ctx).write.mode("overwrite").parquet(f"{root}/summary")
    rows = flagged.where(col(ctx.enu).isNotNull() & (any_flag(flagged) == 1))
    spread_by_key(rows, ctx.enu, rows_per_file).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file) \
        .partitionBy(ctx.enu).parquet(f"{root}/rows")


# -- H6 / W4: issue catalogue and ranking -------------------------------------------

# Severity of each (module, check); checks not listed are "info".
SEVERITY = {
    ("Timing", "LongDuration"): "warn",
    ("Timing", "ShortDuration"): "critical",
    ("Timing", "AbnormalHour"): "warn",
    ("FCS", "Low"): "warn",
    ("FCS", "LowStaple"): "warn",
    ("FCS", "Identical"): "critical",
    ("FCS", "Missing"): "warn",
    ("rCSI", "AdultMealNoChildren"): "warn",
    ("rCSI", "ZeroWithPoorFCG"): "critical",
    ("rCSI", "Identical"): "critical",
    ("rCSI", "Missing"): "warn",
    ("LCS", "ManyNA"): "warn",
    ("LCS", "NonSequential"): "warn",
    ("LCS", "AllNA_PoorFood"): "critical",
    ("LCS", "ChildStratNoChildren"): "warn",
    ("LCS", "Missing"): "warn",
    ("Demo", "SumMismatch"): "warn",
    ("Demo", "Missing"): "warn",
    ("Housing", "DisplacedOwner"): "warn",
    ("Housing", "Missing"): "warn",
    ("HHExpF", "ExtremeItem"): "warn",
    ("HHExpF", "Missing"): "warn",
    ("HDDS", "Low"): "warn",
    ("HDDS", "Missing"): "warn",
}
# Order of the severities.
SEVERITY_RANK = {"critical": 0, "warn": 1, "info": 2}

# Our own words for every check: what it means and what to do about it.
CHECK_TEXTS = {
    "Missing": ("Answers the module needs are blank.", "Have the enumerator fill the blanks in, or record why they stay blank."),
    "Erroneous": ("An answer lies outside its codes or range.", "Correct the answer at its source, or blank it."),
    "HighHHSize": ("The household is unusually large.", "Confirm that one household was interviewed, not several."),
    "SumMismatch": ("The roster does not add up to the stated size.", "Count the members again with the respondent."),
    "NoAdults": ("The roster has no adult.", "Ask who heads the household and complete the roster."),
    "PLWExceeds": ("More pregnant or nursing women than women of that age.", "Compare the count with the roster's ages."),
    "Identical": ("All answers of the block are the same number.", "Watch an interview: the block may be filled in without asking."),
    "LowStaple": ("Hardly any staple food in the week.", "Ask again what the household ate as its main food."),
    "Low": ("The score is implausibly low.", "Check a few of these households by phone or visit."),
    "High": ("The score is implausibly high.", "Check whether days were counted per food or per meal."),
    "AllGroups": ("Every food group was eaten.", "Ask for the dishes of the day and compare."),
    "ZeroWithPoorFCG": ("Poor diet without any coping.", "Go through both sections together with the enumerator."),
    "HighWithAcceptFCG": ("Heavy coping with an acceptable diet.", "Ask which of the two sections the respondent misunderstood."),
    "AdultMealNoChildren": ("Adults ate less for children that are not there.", "Check the roster for missing children."),
    "DisplacedOwner": ("A displaced household owns its dwelling.", "Confirm the status and whose dwelling it is."),
    "ChildStratNoChildren": ("A strategy about children without children.", "Check the roster for missing children."),
    "AllNA_PoorFood": ("Nothing applies although the diet is poor.", "Interview the household again with another enumerator."),
    "NonSequential": ("Emergency measures without milder ones before.", "Ask what the household had tried earlier."),
    "ManyNA": ("Many strategies are said not to apply.", "Explain again when an answer may be not applicable."),
    "ZeroTotal": ("No expenditure at all in the block.", "Ask for the last purchase and gifts received."),
    "BelowMinPrice": ("An amount below any real price.", "Check the currency and the unit of the amount."),
    "ExtremeItem": ("One amount is far beyond the usual.", "Check for an extra zero or a total put into one item."),
    "InvalidDuration": ("The interview took no time.", "Check the clock of the device."),
    "ShortDuration": ("The interview was too short to be complete.", "Repeat some of these interviews independently."),
    "LongDuration": ("The interview took unusually long.", "Ask whether the form was left open or interrupted."),
    "AbnormalHour": ("The interview began outside working hours.", "Check the clock and where the interview took place."),
}
OTHER_CHECK = ("A check of this survey's own.", "Look at the flagged rows with the enumerator.")


def catalogue(spark: SparkSession) -> DataFrame:
    """H6: (module, check) -> severity, rank, description, action.  Fixed size: the known checks."""
    known = list(SEVERITY) + [(m, c) for m in P.MODULE_ORDER for c in CHECK_TEXTS if (m, c) not in SEVERITY]
    rows = [(m, c, SEVERITY.get((m, c), "info"), SEVERITY_RANK[SEVERITY.get((m, c), "info")], *CHECK_TEXTS.get(c, OTHER_CHECK)) for m, c in known]
    return spark.createDataFrame(rows, "module string, check string, severity string, severity_rank int, description string, action string")


def issue_ranking(flagged: DataFrame) -> DataFrame:
    """Every check that fired with its catalogue entry: critical first, then by count.
    A screen shows the first 20 (``present(max_rows=20)``)."""
    counts = M.check_counts(flagged, with_total=True).where(F.col("n_flagged") > 0)
    cat = catalogue(flagged.sparkSession)
    # The catalogue has a fixed, small row count: broadcasting it is bounded.
    joined = counts.join(F.broadcast(cat), ["module", "check"], "left")
    ranked = joined.select(
        "module", "check", "n_flagged", "check_pos", F.coalesce(F.col("severity"), F.lit("info")).alias("severity"),
        F.coalesce(F.col("severity_rank"), F.lit(SEVERITY_RANK["info"])).alias("severity_rank"),
        F.coalesce(F.col("description"), F.lit(OTHER_CHECK[0])).alias("description"),
        F.coalesce(F.col("action"), F.lit(OTHER_CHECK[1])).alias("action"),
        (F.col("n_flagged") / F.col("n_rows") * 100.0).alias("pct"),
    )
    order = Window.orderBy("severity_rank", F.desc("n_flagged"), "check_pos")  # <= #checks rows
    return ranked.withColumn("rank", F.row_number().over(order)).orderBy("rank")


# -- T1 - T3: progress against the sample target ------------------------------------

def progress(flagged: DataFrame, ctx: Context, target: int) -> DataFrame:
    """% done, remaining, average per active day, days to finish, band."""
    return progress_of(M.survey_header(flagged, ctx), target)


def progress_of(h: DataFrame, target: int) -> DataFrame:
    """T1 from a survey header."""
    n, days = F.col("n").cast("double"), F.col("days_active")
    remaining = F.greatest(F.lit(target) - F.col("n"), F.lit(0))
    avg = F.try_divide(n, F.when(days > 0, days.cast("double")))
    finish = F.when((avg > 0) & (remaining > 0), F.ceil(F.try_divide(remaining.cast("double"), avg)))
    done = F.try_divide(n, F.lit(float(target)))  # NULL without a target: nothing remains, complete
    frac = F.least(F.coalesce(done, F.lit(1.0)), F.lit(1.0))
    band = F.when(frac >= 0.9, F.lit("green")).when(frac >= 0.5, F.lit("amber")).otherwise(F.lit("red"))
    return h.select("n", F.lit(target).alias("target"), (done * 100.0).alias("pct_done"),
                    remaining.cast("bigint").alias("remaining"), "days_active", avg.alias("avg_per_day"),
                    finish.cast("bigint").alias("days_to_finish"), (remaining == 0).alias("complete"), band.alias("band"))


def _completion(counts: DataFrame, key: str, target: int) -> DataFrame:
    """Per-group target = round-half-even(target / #groups); status on the 1-decimal %.
    A target that rounds to 0 has no percentage (NULL) and nothing remaining."""
    k = counts.agg(F.count(F.lit(1)).alias("k")).scalar()
    out = counts.withColumn("target", F.bround(F.try_divide(F.lit(float(target)), k.cast("double")), 0).cast("bigint"))
    pct = F.try_divide(F.col("completed").cast("double"), F.col("target").cast("double")) * 100.0
    shown = F.coalesce(F.bround(pct, 1), F.lit(100.0))
    status = F.when(shown >= 80, F.lit("On track")).when(shown >= 50, F.lit("Behind")).otherwise(F.lit("Critical"))
    return out.select(key, "completed", "target", pct.alias("pct_done"),
                      F.greatest(F.col("target") - F.col("completed"), F.lit(0)).alias("remaining"), status.alias("status"))


def enumerator_completion(flagged: DataFrame, ctx: Context, target: int) -> DataFrame:
    """Completion per enumerator, most completed first."""
    counts = M.surveys_per(flagged, ctx.enu, "enumerator").withColumnRenamed("surveys", "completed")
    return _completion(counts, "enumerator", target).orderBy(F.desc("completed"), "enumerator")


def area_completion(flagged: DataFrame, ctx: Context, target: int) -> DataFrame:
    """Completion per area, least done first."""
    counts = M.surveys_per(flagged, ctx.area, "area").withColumnRenamed("surveys", "completed")
    return _completion(counts, "area", target).orderBy("pct_done", "area")


# -- T4 / T5: alerts and recommendations ---------------------------------------------

# The checks whose counts the recommendations name.
RULE_CHECKS = {"short": ("Timing", "ShortDuration"), "many_na": ("LCS", "ManyNA"), "mismatch": ("Demo", "SumMismatch"),
               "zero_poor": ("rCSI", "ZeroWithPoorFCG"), "identical": ("FCS", "Identical")}


def quality_groups(flagged: DataFrame, ctx: Context) -> DataFrame:
    """The figures behind alerts and recommendations, from one pass over the rows.

    kind ('all', 'enumerator', 'area'), name, n, ids (distinct flagged ids), rate (1 decimal),
    and for 'all' duplicated ids, straight-line rows and check counts.  Rows are first
    aggregated by (id, enumerator, area); a hot id then has as many rows as pairs."""
    idc, groups = col(ctx.hhid), M.fcs_groups_in(flagged)
    part = lambda c: (col(c) if c else F.lit(None)).cast("string")
    sums = {"s": F.count_if(R.safe(M.straight_line(groups))) if groups else F.lit(0).cast("bigint"),
            "poor": F.count_if(col("FCG") == "Poor") if "FCG" in flagged.columns else F.lit(0).cast("bigint")}
    for k, (m, c) in RULE_CHECKS.items():
        sums[k] = F.count_if(col(f"Flag_{m}_{c}") == 1) if f"Flag_{m}_{c}" in flagged.columns else F.lit(0).cast("bigint")
    pairs = flagged.groupBy(idc.alias("id"), part(ctx.enu).alias("e"), part(ctx.area).alias("a")).agg(
        F.count(F.lit(1)).alias("n"), F.max(any_flag(flagged)).alias("f"), *[v.alias(k) for k, v in sums.items()])
    by_id, flag = Window.partitionBy("id"), (F.max("f").over(Window.partitionBy("id")) == 1) & F.col("id").isNotNull()
    once = lambda *keys: (F.row_number().over(Window.partitionBy("id", *keys).orderBy("e", "a")) == 1) & flag
    seen = pairs.withColumns({"in_e": once("e"), "in_a": once("a"), "in_all": once(),
                              "dup": (F.row_number().over(by_id.orderBy("e", "a")) == 1)
                              & (F.sum("n").over(by_id) > 1) & F.col("id").isNotNull()})
    cells = F.array(F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("in_all").alias("first")),
                    F.struct(F.lit("enumerator").alias("kind"), F.col("e").alias("name"), F.col("in_e").alias("first")),
                    F.struct(F.lit("area").alias("kind"), F.col("a").alias("name"), F.col("in_a").alias("first")))
    long = seen.select("n", "dup", *sums, F.explode(cells).alias("g")).where("g.kind = 'all' OR g.name IS NOT NULL")
    out = long.groupBy("g.kind", "g.name").agg(F.sum("n").alias("n"), F.count_if("g.first").alias("ids"), F.count_if("dup").alias("dup"),
                                               *[F.sum(k).alias(k) for k in sums])
    pct = lambda c: F.bround(F.try_divide(F.col(c).cast("double"), F.col("n").cast("double")) * 100.0, 1)
    return out.withColumns({"rate": pct("ids"), "poor_pct": pct("poor")})


def _fired(rows: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """(position, level, code, entity, value) of the rules (position, level, code, kind, value, condition) that hold."""
    cells = F.array(*[F.struct(F.lit(p).alias("position"), F.lit(level).cast("string").alias("level"), F.lit(code).alias("code"),
                               F.col("name").alias("entity"), value.cast("double").alias("value"),
                               R.safe((F.col("kind") == kind) & cond).alias("fires")) for p, level, code, kind, value, cond in rules])
    return rows.select(F.explode(F.filter(cells, lambda c: c["fires"])).alias("r")).select("r.position", "r.level", "r.code", "r.entity", "r.value")


def priority_alerts(flagged: DataFrame, dash: Context, report: Context) -> DataFrame:
    """T4: duplicate ids, overall rate > 20, enumerator / area rate > 30, straight-lining.

    Every alert, in that order and by rate within a rule; a screen shows the first 12
    (``present(max_rows=12)``).  Duplicates are those of the dashboard's id column, rates
    those of the report's."""
    rows = quality_groups(flagged, report)
    if dash.hhid and dash.hhid != report.hhid:
        dups = M.duplicate_ids(flagged, dash).agg(F.count(F.lit(1)).alias("n")).scalar()
        rows = rows.withColumn("dup", F.when(F.col("kind") == "all", dups))
    rate = F.col("rate")
    return _fired(rows, [
        (0, "critical", "duplicate_ids", "all", F.col("dup"), F.col("dup") > 0),
        (1, "critical", "overall_flag_rate", "all", rate, rate > 20),
        (2, "warning", "enumerator_flag_rate", "enumerator", rate, rate > 30),
        (3, "warning", "area_flag_rate", "area", rate, rate > 30),
        (4, "warning", "straight_lining", "all", F.col("s"), F.col("s") > 0),
    ]).withColumnRenamed("code", "rule").orderBy("position", F.desc("value"), "entity")


def recommendations(flagged: DataFrame, ctx: Context) -> DataFrame:
    """T5: which follow-up rules fire: (position, code, value, entity).

    A rule about enumerators or areas gives a row for each of them with its rate, highest
    first (a screen names the first few).  The reader supplies the wording."""
    rows, rate = quality_groups(flagged, ctx), F.col("rate")
    count = lambda k: (F.col(k), F.col(k) > 0)
    fired = _fired(rows, [
        (0, None, "overall_rate_above_20", "all", rate, rate > 20),
        (1, None, "overall_rate_above_10", "all", rate, (rate > 10) & (rate <= 20)),
        (2, None, "enumerators_above_30", "enumerator", rate, rate > 30),
        (3, None, "enumerators_15_to_30", "enumerator", rate, (rate > 15) & (rate <= 30)),
        (4, None, "poor_fcg_above_30", "all", F.col("poor_pct"), F.col("poor_pct") > 30),
        (5, None, "short_interviews", "all", *count("short")),
        (6, None, "many_lcs_not_applicable", "all", *count("many_na")),
        (7, None, "roster_mismatch", "all", *count("mismatch")),
        (8, None, "no_coping_with_poor_fcg", "all", *count("zero_poor")),
        (9, None, "identical_fcs", "all", *count("identical")),
        (10, None, "areas_above_30", "area", rate, rate > 30),
    ]).drop("level")
    fallback = fired.agg(F.count(F.lit(1)).alias("k")).where("k = 0").select(
        F.lit(11).alias("position"), F.lit("quality_acceptable").alias("code"),
        F.lit(None).cast("string").alias("entity"), F.lit(None).cast("double").alias("value"))
    return fired.unionByName(fallback).orderBy("position", F.desc("value"), "entity")


# -- W3 / G21 / B11 / W6 / A6: presentation helpers and the deliverables sink --------

def top_enumerators(flagged: DataFrame, ctx: Context, n: int = 20) -> DataFrame:
    """The n enumerators with the highest flag rate (ties by name) — a top-n report."""
    return M.flag_rate_by_enumerator(flagged, ctx).orderBy(F.desc(F.bround("rate_pct", 1)), "enumerator").limit(n)


def submission_pivot(flagged: DataFrame, ctx: Context, days: Sequence) -> DataFrame:
    """G21 wide form: one row per enumerator, one column for each of the given days."""
    long = M.submission_matrix(flagged, ctx)
    return long.groupBy("enumerator").pivot("date", list(days)).agg(F.first("n")).na.fill(0)


def present(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """B11 + W6: display form — flag columns as whole numbers, other doubles to 1 decimal
    (half-even), optionally the first ``max_rows`` rows.  For screens only; tables and
    files keep full precision."""
    cols = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name.startswith("Flag_") and f.dataType.typeName() in ("double", "float", "integer"):
            c = F.bround(c, 0).cast("int")
        elif f.dataType.typeName() in ("double", "float"):
            c = F.bround(c, 1)
        cols.append(c.alias(f.name))
    out = df.select(*cols)
    return out.limit(max_rows) if max_rows else out


def write_deliverables(flagged: DataFrame, ctx: Context, path: str, profile: P.Profile | None = None) -> None:
    """Summary, check counts, master sheet (+ long narratives) and per-module error logs."""
    root = path.rstrip("/")
    M.module_summary(flagged).write.mode("overwrite").parquet(f"{root}/summary")
    M.check_counts(flagged).write.mode("overwrite").parquet(f"{root}/check_counts")
    master_sheet(flagged, ctx).write.mode("overwrite").parquet(f"{root}/master_sheet")
    master_narratives(flagged, ctx).write.mode("overwrite").partitionBy("module").parquet(f"{root}/master_narratives")
    write_error_logs(flagged, f"{root}/error_logs", profile)
