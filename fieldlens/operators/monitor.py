"""Monitoring tables over the flagged survey.

Every function takes the flagged DataFrame ``F`` (ideally the materialized
table, see ``plans.materialize``) and a resolved ``Context`` and returns a lazy
DataFrame.  Conventions that keep these plans safe at scale:

* global figures come from one ``agg`` pass, reshaped with ``unpivot``;
* group-bys rely on partial (map-side) aggregation, so a hot enumerator or
  area only ever ships one partial row per task;
* distinct-id figures first collapse to one row per ``(id, group)`` pair, so a
  hot id shows up as at most (#groups) rows afterwards;
* windows run only on already aggregated tables (days, groups);
* one-row thresholds reach the rows as scalar subqueries, never as joins.

Percentages are published unrounded (display rounding is a presentation
concern, see ``deliver.present``).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions import columns as R
from ..functions.context import Context
from ..functions.columns import col
from ..plans.engine import any_flag, module_flag_columns, modules_in
from .checks import highest_tier
from .quantiles import BROADCAST_GROUPS, exact_quantiles


def _cnt(cond: Column) -> Column:
    return F.count_if(R.safe(cond))


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


def _need(name: str | None, what: str) -> str:
    if not name:
        raise ValueError(f"no {what} column in this survey")
    return name


# -- D8 / D9 / D11 / D12 bands -----------------------------------------------

def rcsi_severity(c: Column) -> Column:
    """(-1,3] Low, (3,18] Medium, (18,9999] High, else NULL."""
    return (F.when((c > -1) & (c <= 3), F.lit("Low"))
            .when((c > 3) & (c <= 18), F.lit("Medium"))
            .when((c > 18) & (c <= 9999), F.lit("High")))


def hhs_score(columns: Sequence[str]) -> Column:
    """Household hunger score, NULL answers as 0."""
    return R.sum_nulls_as_zero(list(columns))


def hhs_band(c: Column) -> Column:
    """D9 bins (-1,0] (0,1] (1,3] (3,4] (4,6]."""
    return (F.when((c > -1) & (c <= 0), F.lit("0")).when((c > 0) & (c <= 1), F.lit("1"))
            .when((c > 1) & (c <= 3), F.lit("2-3")).when((c > 3) & (c <= 4), F.lit("4"))
            .when((c > 4) & (c <= 6), F.lit("5-6")))


def consistency_rcsi_band(c: Column) -> Column:
    """rCSI bins of the consistency matrix: (-1,3] (3,18] (18,56]."""
    return (F.when((c > -1) & (c <= 3), F.lit("<4")).when((c > 3) & (c <= 18), F.lit("4-18"))
            .when((c > 18) & (c <= 56), F.lit(">18")))


def hdds_band(c: Column) -> Column:
    """<=3 Low, 4-6 Medium, >=7 High (values in between fall in no band)."""
    return F.when(c <= 3, F.lit("Low")).when((c >= 4) & (c <= 6), F.lit("Medium")).when(c >= 7, F.lit("High"))


def straight_line(columns: Sequence[str]) -> Column:
    """At least two answers and all answers equal (zeros included)."""
    cols = [col(c) for c in columns]
    if len(cols) < 2:
        return F.lit(False)
    answered = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return (answered >= 2) & (F.greatest(*cols) == F.least(*cols))


def fcs_groups_in(flagged: DataFrame) -> list[str]:
    return [c for c in P.FCS_GROUPS if c in flagged.columns]


def rate_band_report(rate: Column) -> Column:
    """T6 (report): Critical > 20, High > 10, Medium > 0, else OK."""
    return (F.when(rate > 20, F.lit("Critical")).when(rate > 10, F.lit("High"))
            .when(rate > 0, F.lit("Medium")).otherwise(F.lit("OK")))


def rate_band_workbook(rate: Column) -> Column:
    """T6 (workbook): > 20 high, > 10 medium, > 5 low, else ok."""
    return (F.when(rate > 20, F.lit("high")).when(rate > 10, F.lit("medium"))
            .when(rate > 5, F.lit("low")).otherwise(F.lit("ok")))


# -- G1 / G2: module and check summaries ---------------------------------------

def module_summary(flagged: DataFrame) -> DataFrame:
    """G1: per module total rows, flagged rows, rate % and band (one pass)."""
    mods = modules_in(flagged)
    one = flagged.agg(F.count(F.lit(1)).alias("total"),
                      *[_cnt(col(f"Flag_{m}_Overall") == 1).alias(m) for m in mods])
    long = one.unpivot(["total"], mods, "module", "flagged")
    rate = _pct(F.col("flagged"), F.col("total"))
    return long.select("module", F.col("total").alias("total_records"), F.col("flagged").alias("flagged_records"),
                       rate.alias("flag_rate_pct"), rate_band_workbook(rate).alias("rate_band"))


def check_counts(flagged: DataFrame, with_total: bool = False) -> DataFrame:
    """G1 long form: rows with each check flag = 1, for every check column (one pass).

    ``with_total`` adds the row count (``n_rows``) from the same pass.
    """
    names = [(m, c) for m in modules_in(flagged) for c in module_flag_columns(flagged, m)]
    one = flagged.agg(F.count(F.lit(1)).alias("n_rows"), *[_cnt(col(c) == 1).alias(f"c{i}") for i, (_, c) in enumerate(names)])
    prefix = [f"Flag_{m}_" for m, _ in names]
    stack = ", ".join(f"'{m}', '{c[len(p):]}', {i}, c{i}" for i, ((m, c), p) in enumerate(zip(names, prefix)))
    out = one.selectExpr("n_rows", f"stack({len(names)}, {stack}) AS (module, check, check_pos, n_flagged)")
    out = out.select("module", "check", "n_flagged", "check_pos", "n_rows")
    return out if with_total else out.drop("n_rows")


def top_checks(flagged: DataFrame) -> DataFrame:
    """Checks that fired, most frequent first."""
    return check_counts(flagged).where(F.col("n_flagged") > 0).orderBy(F.desc("n_flagged"), "check_pos")


# -- G3 / G4 / G5: distinct-id flag rates --------------------------------------

def flagged_ids(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Number of distinct ids flagged in any module, and the rate over all rows."""
    idc = col(_need(ctx.hhid, "id"))
    out = flagged.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.count_distinct(F.when(any_flag(flagged) == 1, idc)).alias("total_flagged_ids"))
    return out.withColumn("overall_rate_pct", _pct(F.col("total_flagged_ids"), F.col("n_rows")))


def _id_pairs(flagged: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """One row per (id, group) with its row count, then the id's flag over all groups."""
    pairs = (flagged.groupBy(col(id_col).alias("_id"), col(group_col).alias("_g"))
             .agg(F.count(F.lit(1)).alias("_n"), F.max(any_flag(flagged)).alias("_f")))
    # Bounded window: after the pre-aggregation an id has at most (#groups + 1) rows.
    return pairs.withColumn("_idf", F.max("_f").over(Window.partitionBy("_id")))


def flag_rate_by(flagged: DataFrame, ctx: Context, key: str, out_name: str) -> DataFrame:
    """surveys = rows of the group; flagged = distinct flagged ids of the group."""
    g = _need(key, out_name)
    pairs = _id_pairs(flagged, _need(ctx.hhid, "id"), g).where(F.col("_g").isNotNull())
    out = pairs.groupBy(F.col("_g").alias(out_name)).agg(
        F.sum("_n").alias("surveys"),
        F.count_if((F.col("_idf") == 1) & F.col("_id").isNotNull()).alias("flagged"),
    )
    rate = _pct(F.col("flagged"), F.col("surveys"))
    # The total is one number, read as a scalar subquery.
    total = flagged.where(col(g).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    share = _pct(F.col("surveys"), total)
    return (out.withColumn("rate_pct", rate).withColumn("rate_band", rate_band_report(rate))
            .withColumn("survey_share_pct", share))


def flag_rate_by_enumerator(flagged: DataFrame, ctx: Context) -> DataFrame:
    return flag_rate_by(flagged, ctx, ctx.enu, "enumerator")


def flag_rate_by_area(flagged: DataFrame, ctx: Context) -> DataFrame:
    return flag_rate_by(flagged, ctx, ctx.area, "area")


# -- G6 / G7 / W1 / W2: header and timeline ------------------------------------

def _moment(flagged: DataFrame, c: str) -> Column:
    """A date column as a timestamp; text that is no date becomes NULL."""
    if flagged.schema[c].dataType.typeName() == "string":
        return F.try_to_timestamp(col(c))
    return col(c).cast("timestamp")


def _day(flagged: DataFrame, c: str) -> Column:
    return F.to_date(_moment(flagged, c))


def survey_header(flagged: DataFrame, ctx: Context) -> DataFrame:
    """G6 + T8: n, date range, days active, distinct enumerators and areas."""
    d = _moment(flagged, _need(ctx.date, "date"))
    one = flagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(d).alias("_lo"), F.max(d).alias("_hi"),
        (F.count_distinct(col(ctx.enu)) if ctx.enu else F.lit(0)).alias("n_enumerators"),
        (F.count_distinct(col(ctx.area)) if ctx.area else F.lit(0)).alias("n_areas"),
    )
    elapsed = F.floor((F.unix_seconds(F.col("_hi")) - F.unix_seconds(F.col("_lo"))) / 86400)
    return one.select(
        "n", F.to_date("_lo").alias("date_min"), F.to_date("_hi").alias("date_max"),
        F.coalesce(elapsed + 1, F.lit(0)).cast("bigint").alias("days_active"),
        F.col("n_enumerators").cast("bigint").alias("n_enumerators"), F.col("n_areas").cast("bigint").alias("n_areas"),
        F.try_divide(F.col("n").cast("double"), F.greatest(F.col("n_enumerators"), F.lit(1)).cast("double"))
        .alias("surveys_per_enumerator"),
    )


def daily_counts(flagged: DataFrame, ctx: Context, target: int = 0) -> DataFrame:
    """G7 + W1 + W2: submissions per day, running total and the expected pace line."""
    day = _day(flagged, _need(ctx.date, "date"))
    days = flagged.where(day.isNotNull()).groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("date")  # on <= #days rows, after aggregation
    out = days.withColumn("cumulative", F.sum("n").over(w))
    if target > 0:
        n_days = F.count(F.lit(1)).over(Window.partitionBy())  # days
        out = out.withColumn("expected", F.lit(float(target)) / n_days * F.row_number().over(w))
    return out


# -- G8 - G13: distributions and means ---------------------------------------------

def _labelled_counts(flagged: DataFrame, labels: Sequence[str], band: Column, extra: dict[str, Column]) -> DataFrame:
    aggs = [_cnt(band == lab).alias(f"c{i}") for i, lab in enumerate(labels)]
    one = flagged.agg(*aggs, *[v.alias(k) for k, v in extra.items()])
    stack = ", ".join(f"'{lab}', {i}, c{i}" for i, lab in enumerate(labels))
    return one.selectExpr(*extra, f"stack({len(labels)}, {stack}) AS (label, label_pos, n)")


def fcg_dist(flagged: DataFrame) -> DataFrame:
    """FCG counts (0-filled), % of all rows and % of classified rows."""
    out = _labelled_counts(flagged, ["Poor", "Borderline", "Acceptable"], col("FCG"),
                           {"n_rows": F.count(F.lit(1)), "n_classified": F.count(col("FCG"))})
    return out.select("label", "label_pos", "n", _pct(F.col("n"), F.col("n_rows")).alias("pct_all"),
                      _pct(F.col("n"), F.col("n_classified")).alias("pct_classified"))


def rcsi_dist(flagged: DataFrame) -> DataFrame:
    """Low <= 3, Medium 4-18, High >= 19 (3 < x < 4 and 18 < x < 19 fall in no band)."""
    r = col("rCSI")
    band = F.when(r <= 3, "Low").when((r >= 4) & (r <= 18), "Medium").when(r >= 19, "High")
    out = _labelled_counts(flagged, ["Low", "Medium", "High"], band, {"n_scored": F.count(r)})
    return out.select("label", "label_pos", "n", _pct(F.col("n"), F.col("n_scored")).alias("pct_scored"))


def hdds_dist(flagged: DataFrame) -> DataFrame:
    """HDDS bands <= 3, 4-6, >= 7."""
    out = _labelled_counts(flagged, ["Low", "Medium", "High"], hdds_band(col("HDDS")), {"n_scored": F.count(col("HDDS"))})
    return out.select("label", "label_pos", "n", _pct(F.col("n"), F.col("n_scored")).alias("pct_scored"))


def lcs_columns(flagged: DataFrame) -> list[str]:
    """LCS columns found by prefix, in table order."""
    return [c for c in flagged.columns if c.startswith(("Lcs_stress_", "Lcs_crisis_", "Lcs_em_"))]


def lcs_tier_dist(flagged: DataFrame) -> DataFrame:
    """Households by highest coping tier reached (0-filled)."""
    tier = highest_tier(set(lcs_columns(flagged)))
    out = _labelled_counts(flagged, ["No coping", "Stress", "Crisis", "Emergency"], tier, {"n_rows": F.count(F.lit(1))})
    return out.select("label", "label_pos", "n", _pct(F.col("n"), F.col("n_rows")).alias("pct_all"))


def score_means(flagged: DataFrame) -> DataFrame:
    """Mean FCS, rCSI and HDDS (NULLs skipped)."""
    return flagged.agg(F.avg(col("FCS")).alias("mean_fcs"), F.avg(col("rCSI")).alias("mean_rcsi"),
                       F.avg(col("HDDS")).alias("mean_hdds"))


def duration_stats(flagged: DataFrame) -> DataFrame:
    """Mean and median interview minutes (median by distributed exact selection)."""
    d = col("Timing_Duration_Min")
    med = exact_quantiles(flagged, None, "Timing_Duration_Min", [0.5], ["median"]).select("median").scalar()
    return flagged.agg(F.avg(d).alias("mean_minutes"), F.count(d).alias("n_timed")).select(
        "mean_minutes", med.alias("median_minutes"), "n_timed")


# -- G14 - G21: enumerator behaviour -------------------------------------------

def surveys_per(flagged: DataFrame, key: str, out_name: str) -> DataFrame:
    """Surveys per group (NULL group dropped)."""
    return (flagged.where(col(key).isNotNull()).groupBy(col(key).alias(out_name))
            .agg(F.count(F.lit(1)).alias("surveys")))


def duplicate_ids(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Ids that occur on more than one row (NULL ids ignored)."""
    idc = _need(ctx.hhid, "id")
    return (flagged.where(col(idc).isNotNull()).groupBy(col(idc).alias("id"))
            .agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1))


# Columns shown beside a duplicated id.
DUPLICATE_DETAIL = ("HHSize", "HHStatus", "FCS", "FCG", "rCSI", "Timing_Duration_Min")


def duplicate_rows(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Every row of a duplicated id, side by side, ordered by id."""
    idc = _need(ctx.hhid, "id")
    dups = duplicate_ids(flagged, ctx).select(F.col("id").alias("_dup"), F.xxhash64("id").alias("_hash"))
    keep = list(dict.fromkeys([c for c in [idc, ctx.enu, ctx.area, ctx.date] if c]
                              + [c for c in DUPLICATE_DETAIL if c in flagged.columns] + ["row_seq"]))
    rows = flagged.select(*[col(c) for c in keep])
    # AQE only splits a hot id where both inputs are plain exchanges.  The counts lie on an
    # aggregate by id, which would be joined as it stands; the second key asks for an
    # exchange of its own above it (a few bytes an id).
    return rows.join(dups, (col(idc) == F.col("_dup")) & (F.xxhash64(col(idc)) == F.col("_hash")), "left_semi") \
        .orderBy(col(idc), "row_seq")


def straight_lining(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Straight-line FCS records per enumerator (only enumerators with any)."""
    enu = _need(ctx.enu, "enumerator")
    sl = straight_line(fcs_groups_in(flagged))
    return (flagged.where(col(enu).isNotNull() & R.safe(sl)).groupBy(col(enu).alias("enumerator"))
            .agg(F.count(F.lit(1)).alias("straight_line")))


def behaviour_totals(flagged: DataFrame) -> DataFrame:
    """G16 + G30: straight-line rows of the whole survey (rows without an enumerator
    included) and the share of illogical rows among those with both bands."""
    groups = fcs_groups_in(flagged)
    hb = hhs_band(hhs_score([c for c in P.HHS_COLUMNS if c in flagged.columns]))
    rb = consistency_rcsi_band(col("rCSI"))
    odd = hb.isin("2-3", "4", "5-6") & (rb == "<4") & col("FCG").isin("Acceptable", "Borderline")
    one = flagged.agg((_cnt(straight_line(groups)) if groups else F.lit(0).cast("bigint")).alias("straight_line"),
                      _cnt(hb.isNotNull() & rb.isNotNull()).alias("total"), _cnt(odd).alias("illogical"))
    return one.withColumn("illogical_pct", _pct(F.col("illogical"), F.col("total")))


KEY_MISSING_COLUMNS = ("FCSStap", "rCSILessQlty", "HHSize")


def _enumerator_aggs(flagged: DataFrame, ctx: Context) -> dict[str, Column]:
    """G17, G18, G19, G16 as aggregate expressions for one groupBy(enumerator)."""
    aggs: dict[str, Column] = {}
    keys = [c for c in KEY_MISSING_COLUMNS if c in flagged.columns]
    if keys:
        parts = [F.avg(col(c).isNull().cast("int")) for c in keys]
        aggs["missing_pct"] = reduce(lambda a, b: a + b, parts) / F.lit(float(len(keys))) * F.lit(100.0)
    if "Timing_Duration_Min" in flagged.columns:
        d = col("Timing_Duration_Min")
        aggs["avg_duration_min"] = F.avg(F.when((d > 0) & (d < 300), d))
    if ctx.sup:
        aggs["supervisor"] = F.min_by(col(ctx.sup), F.when(col(ctx.sup).isNotNull(), col("row_seq")))
    groups = fcs_groups_in(flagged)
    if groups:
        n_sl = F.count_if(R.safe(straight_line(groups)))
        aggs["straight_line"] = F.when(n_sl > 0, n_sl)
    return aggs


def missing_pct_by_enumerator(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Mean over the key columns of the share of NULL answers, in %."""
    enu = _need(ctx.enu, "enumerator")
    a = _enumerator_aggs(flagged, ctx)
    return flagged.where(col(enu).isNotNull()).groupBy(col(enu).alias("enumerator")).agg(a["missing_pct"].alias("missing_pct"))


def valid_duration_by_enumerator(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Mean minutes over interviews with 0 < minutes < 300 (enumerators with any)."""
    enu = _need(ctx.enu, "enumerator")
    d = col("Timing_Duration_Min")
    return (flagged.where(col(enu).isNotNull() & (d > 0) & (d < 300)).groupBy(col(enu).alias("enumerator"))
            .agg(F.avg(d).alias("avg_duration_min"), F.count(F.lit(1)).alias("n_valid")))


def enumerator_scorecard(flagged: DataFrame, ctx: Context) -> DataFrame:
    """H1: flag rate (distinct ids) + supervisor, straight-lining, missing %, duration."""
    enu = _need(ctx.enu, "enumerator")
    rates = flag_rate_by_enumerator(flagged, ctx).select("enumerator", "surveys", "flagged", "rate_pct")
    a = _enumerator_aggs(flagged, ctx)
    extra = (flagged.where(col(enu).isNotNull()).groupBy(col(enu).alias("enumerator"))
             .agg(*[v.alias(k) for k, v in a.items()]))
    # Both sides hold one row per enumerator.
    return rates.join(extra, "enumerator", "left").orderBy(F.desc("rate_pct"), "enumerator")


# The scores compared between enumerators.
DEVIATION_METRICS = {"FCS": "FCS", "rCSI": "rCSI", "HDDS": "HDDS", "HHSize": "HHSize", "Duration": "Timing_Duration_Min"}


def enumerator_deviation(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Enumerator means vs the overall mean; deviates if |mean-overall| > 1.5 SD.

    The overall means and deviations are one row, read as a scalar subquery.
    """
    enu = _need(ctx.enu, "enumerator")
    metrics = {k: v for k, v in DEVIATION_METRICS.items() if v in flagged.columns}
    whole = flagged.agg(F.struct(*[x for k, v in metrics.items() for x in (
        F.avg(col(v)).alias(f"o_{k}"), F.stddev_samp(col(v)).alias(f"d_{k}"))]).alias("w")).scalar()
    wide = (flagged.where(col(enu).isNotNull()).groupBy(col(enu).alias("enumerator"))
            .agg(*[F.avg(col(v)).alias(f"m_{k}") for k, v in metrics.items()]).withColumn("w", whole))
    stack = ", ".join(f"'{k}', m_{k}, w.o_{k}, w.d_{k}" for k in metrics)
    long = wide.selectExpr("enumerator", f"stack({len(metrics)}, {stack}) AS (metric, mean, overall_mean, overall_sd)")
    shown = F.bround(F.col("mean"), 2)  # compared as displayed (2 decimals)
    dev = (F.col("overall_sd") != 0) & F.col("mean").isNotNull() & \
        (F.abs(shown - F.col("overall_mean")) > F.lit(1.5) * F.col("overall_sd"))
    return long.withColumn("deviates", F.coalesce(dev, F.lit(False)))


def submission_matrix(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Enumerator x day submission counts (long form; pivot on request)."""
    enu, day = col(_need(ctx.enu, "enumerator")), _day(flagged, _need(ctx.date, "date"))
    return (flagged.where(enu.isNotNull() & day.isNotNull()).groupBy(enu.alias("enumerator"), day.alias("date"))
            .agg(F.count(F.lit(1)).alias("n")))


# -- G22 - G32: breakdowns -------------------------------------------------------

def category_share(flagged: DataFrame, group: str, band: Column, labels: Sequence[str], top_n: int | None = None) -> DataFrame:
    """G22 (+W5): % of each label within the group; NULL group/band rows dropped; 0-filled."""
    g = col(group)
    base = flagged.where(g.isNotNull() & band.isNotNull())
    aggs = [_cnt(band == lab).alias(f"c{i}") for i, lab in enumerate(labels)]
    wide = base.groupBy(g.alias("group")).agg(F.count(F.lit(1)).alias("n_group"), *aggs)
    if top_n:
        sizes = (flagged.where(g.isNotNull()).groupBy(g.alias("group")).agg(F.count(F.lit(1)).alias("_size"))
                 .orderBy(F.desc("_size"), "group").limit(top_n))  # W5: a top-n report
        wide = wide.join(sizes.select("group"), "group", "left_semi")
    stack = ", ".join(f"'{lab}', {i}, c{i}" for i, lab in enumerate(labels))
    long = wide.selectExpr("group", "n_group", f"stack({len(labels)}, {stack}) AS (label, label_pos, n)")
    return long.withColumn("pct", _pct(F.col("n"), F.col("n_group")))


def fcg_share_by_area(flagged: DataFrame, ctx: Context, top_n: int | None = None) -> DataFrame:
    return category_share(flagged, _need(ctx.area, "area"), col("FCG"), ["Poor", "Borderline", "Acceptable"], top_n)


def rcsi_share_by_enumerator(flagged: DataFrame, ctx: Context, top_n: int | None = None) -> DataFrame:
    return category_share(flagged, _need(ctx.enu, "enumerator"), rcsi_severity(col("rCSI")),
                          ["Low", "Medium", "High"], top_n)


def fcg_share_by_enumerator(flagged: DataFrame, ctx: Context, top_n: int | None = None) -> DataFrame:
    return category_share(flagged, _need(ctx.enu, "enumerator"), col("FCG"), ["Poor", "Borderline", "Acceptable"], top_n)


def rcsi_share_by_area(flagged: DataFrame, ctx: Context, top_n: int | None = None) -> DataFrame:
    return category_share(flagged, _need(ctx.area, "area"), rcsi_severity(col("rCSI")), ["Low", "Medium", "High"], top_n)


def mean_by(flagged: DataFrame, key: str, score: str) -> DataFrame:
    """Mean score per group, ascending (rows with NULL group or score dropped)."""
    return (flagged.where(col(key).isNotNull() & col(score).isNotNull()).groupBy(col(key).alias("group"))
            .agg(F.avg(col(score)).alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("mean", "group"))


def score_trend(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Daily mean FCS, rCSI and HDDS."""
    day = _day(flagged, _need(ctx.date, "date"))
    return (flagged.where(day.isNotNull()).groupBy(day.alias("date"))
            .agg(F.avg(col("FCS")).alias("mean_fcs"), F.avg(col("rCSI")).alias("mean_rcsi"),
                 F.avg(col("HDDS")).alias("mean_hdds")))


def lcs_tier_of(name: str) -> str:
    return "Stress" if name.startswith("Lcs_stress_") else "Crisis" if name.startswith("Lcs_crisis_") else "Emergency"


def lcs_response_dist(flagged: DataFrame) -> DataFrame:
    """Strategy x answer code counts (0-filled) and % of all rows."""
    cols = lcs_columns(flagged)
    cells = [(c, code) for c in cols for code in (P.LCS_NA, P.LCS_NOT_NEEDED, P.LCS_EXHAUSTED, P.LCS_APPLIED)]
    one = flagged.agg(F.count(F.lit(1)).alias("n_rows"),
                      *[_cnt(col(c) == code).alias(f"c{i}") for i, (c, code) in enumerate(cells)])
    stack = ", ".join(f"'{c}', '{lcs_tier_of(c)}', {code}, c{i}" for i, (c, code) in enumerate(cells))
    long = one.selectExpr("n_rows", f"stack({len(cells)}, {stack}) AS (strategy, tier, code, n)")
    return long.select("strategy", "tier", "code", "n", _pct(F.col("n"), F.col("n_rows")).alias("pct"))


def lcs_na_rate(flagged: DataFrame, ctx: Context) -> DataFrame:
    """% of N/A answers per strategy and enumerator (denominator: all its rows)."""
    enu = _need(ctx.enu, "enumerator")
    cols = lcs_columns(flagged)
    wide = (flagged.where(col(enu).isNotNull()).groupBy(col(enu).alias("enumerator"))
            .agg(*[(F.avg(R.safe(col(c) == P.LCS_NA).cast("int")) * F.lit(100.0)).alias(f"r{i}")
                   for i, c in enumerate(cols)]))
    stack = ", ".join(f"'{c}', '{lcs_tier_of(c)}', r{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("enumerator", f"stack({len(cols)}, {stack}) AS (strategy, tier, na_pct)")
    return long.withColumn("na_invalid", F.col("tier") == "Emergency")


def five_number(flagged: DataFrame, group: str, value: str) -> DataFrame:
    """Min, quartiles (linear interpolation), max and Tukey fences per group.

    All five come from one distributed exact selection (min = rank 0, max = rank n-1).
    """
    q = exact_quantiles(flagged, group, value, [0.0, 0.25, 0.5, 0.75, 1.0], ["min", "q1", "median", "q3", "max"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(F.col(group).alias("group"), "n", "min", "q1", "median", "q3", "max",
                    (F.col("q1") - 1.5 * iqr).alias("lower_fence"), (F.col("q3") + 1.5 * iqr).alias("upper_fence"))


def box_outliers(flagged: DataFrame, group: str, value: str, id_col: str) -> DataFrame:
    """G27 outlier rows: values outside their group's fences (join on #groups rows)."""
    fences = five_number(flagged, group, value)
    few = fences.count() <= BROADCAST_GROUPS  # of a written table with one row a group
    fences = fences.select("group", F.xxhash64("group").alias("_hash"), "lower_fence", "upper_fence")
    v = col(value)
    rows = flagged.where(col(group).isNotNull() & v.isNotNull()).select(
        col(id_col).alias("id"), col("row_seq"), col(group).alias("group"), v.alias("value"))
    # Beyond that many groups both sides are exchanged, so that AQE can split a hot one (the
    # second key keeps the plan so when the fences come from an aggregate by group).
    joined = rows.withColumn("_hash", F.xxhash64("group")).join(F.broadcast(fences) if few else fences, ["group", "_hash"])
    return joined.where((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))) \
        .select("id", "row_seq", "group", "value")


def score_box_group(ctx: Context) -> str:
    """Score boxes go by area, or by enumerator where the survey has no area."""
    return _need(ctx.area or ctx.enu, "area or enumerator")


def tukey_outliers(flagged: DataFrame, metrics: Sequence[str] = ("FCS", "rCSI")) -> DataFrame:
    """Whole-table Tukey outlier counts (needs >= 4 values).

    All metrics share one long form: one selection of the quartiles, one pass that counts.
    A metric without values has no fences and no outliers."""
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    long = flagged.selectExpr(f"stack({len(metrics)}, {stack}) AS (metric, value)").where(F.col("value").isNotNull())
    q = exact_quantiles(long, "metric", "value", [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("metric", "n", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower_fence"), (F.col("q3") + 1.5 * iqr).alias("upper_fence"))
    beyond = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    # One row a metric on the small sides.
    found = long.join(F.broadcast(fences), "metric").groupBy(*fences.columns).agg(F.count_if(beyond).alias("_o")).select(
        *fences.columns, F.when(F.col("n") >= 4, F.col("_o")).otherwise(F.lit(0)).cast("bigint").alias("n_outliers"))
    named = flagged.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{m}')" for m in metrics) + " AS t(metric)")
    return named.join(F.broadcast(found), "metric", "left").na.fill(0, ["n", "n_outliers"])


def start_hour_hist(flagged: DataFrame, ctx: Context) -> DataFrame:
    """Local start hour per enumerator, 24 one-hour bins."""
    enu = _need(ctx.enu, "enumerator")
    h = col("Timing_StartHour")
    return (flagged.where(col(enu).isNotNull() & h.isNotNull())
            .groupBy(col(enu).alias("enumerator"), F.floor(h).cast("int").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n")))


# Least score, span and number of bins that give the width of a bin.
SCORE_BINS = {"FCS": (0.0, 112.0, 40), "rCSI": (0.0, 56.0, 30)}


def score_hist(flagged: DataFrame) -> DataFrame:
    """Fixed-width histograms of FCS (40 bins of 0 to 112) and rCSI (30 bins of 0 to 56).

    Erroneous answers are scored too: scores beyond the span get the bins that follow (or
    come before) at the same width, none is moved into another bin."""
    parts = []
    for m, (lo, hi, nb) in SCORE_BINS.items():
        width = (hi - lo) / nb
        v = col(m)
        b = F.floor((v - F.lit(lo)) / F.lit(width)).cast("bigint")
        parts.append(flagged.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit(m).alias("metric"), "bin",
                             (F.lit(lo) + F.col("bin").cast("double") * F.lit(hi - lo) / F.lit(float(nb))).alias("bin_start"),
                             "n"))
    return reduce(DataFrame.unionByName, parts)


HHS_BANDS = ("0", "1", "2-3", "4", "5-6")
RCSI_MATRIX_BANDS = ("<4", "4-18", ">18")
FCG_LABELS = ("Acceptable", "Borderline", "Poor")


def consistency_matrix(flagged: DataFrame) -> DataFrame:
    """HHS x rCSI x FCG cells (45, 0-filled) as % of rows with both bands set.

    Illogical = HHS >= 2, FCG Acceptable/Borderline and rCSI <= 3.  Rows with
    a NULL FCG count in the total but in no cell.
    """
    hb = hhs_band(hhs_score([c for c in P.HHS_COLUMNS if c in flagged.columns]))
    rb = consistency_rcsi_band(col("rCSI"))
    # Few groups leave each task; the fixed 45 cells are filled from one row of counts.
    bands = flagged.select(hb.alias("h"), rb.alias("r"), col("FCG").alias("f")).where("h IS NOT NULL AND r IS NOT NULL")
    counts = bands.groupBy("h", "r", "f").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.collect_list(F.when(  # 60 groups at most
        F.col("f").isNotNull(), F.struct(F.concat_ws("|", "h", "r", "f"), "n")))).alias("by"))
    cells = [(h, r, f) for h in HHS_BANDS for r in RCSI_MATRIX_BANDS for f in FCG_LABELS]
    stack = ", ".join(f"'{h}', '{r}', '{f}', coalesce(by['{h}|{r}|{f}'], 0L)" for h, r, f in cells)
    long = one.selectExpr("total", f"stack({len(cells)}, {stack}) AS (hhs_band, rcsi_band, fcg, n)")
    illogical = F.col("hhs_band").isin("2-3", "4", "5-6") & F.col("fcg").isin("Acceptable", "Borderline") & \
        (F.col("rcsi_band") == "<4")
    return long.select("hhs_band", "rcsi_band", "fcg", "n", "total", _pct(F.col("n"), F.col("total")).alias("pct"),
                       illogical.alias("illogical"))


def expenditure_items(flagged: DataFrame) -> list[str]:
    """Food expenditure columns of the survey, in declared order."""
    return [c for c in P.EXP_COLUMNS["HHExpF"] if c in flagged.columns]


def expenditure_extremes(flagged: DataFrame, k: int = 5) -> DataFrame:
    """Per item the k smallest, k largest and the median amount.

    The row_number filter is planned as a partial WindowGroupLimit before the
    shuffle, so each task ships at most k rows per item.
    """
    items = expenditure_items(flagged)
    stack = ", ".join(f"'{c}', `{c}`" for c in items)
    long = flagged.selectExpr(f"stack({len(items)}, {stack}) AS (item, value)").where(F.col("value").isNotNull())
    low = long.withColumn("pos", F.row_number().over(Window.partitionBy("item").orderBy(F.asc("value")))) \
        .where(F.col("pos") <= k).withColumn("kind", F.lit("smallest"))
    high = long.withColumn("pos", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("value")))) \
        .where(F.col("pos") <= k).withColumn("kind", F.lit("largest"))
    med = exact_quantiles(long, "item", "value", [0.5], ["value"]).select(
        "item", "value", F.lit(1).alias("pos"), F.lit("median").alias("kind"))
    return low.unionByName(high).unionByName(med).select("item", "kind", F.col("pos").cast("int").alias("pos"), "value")


def missing_rate_matrix(flagged: DataFrame, ctx: Context) -> DataFrame:
    """% of rows with Flag_<module>_Missing = 1, module x enumerator."""
    enu = _need(ctx.enu, "enumerator")
    mods = [m for m in modules_in(flagged) if f"Flag_{m}_Missing" in flagged.columns]
    wide = (flagged.where(col(enu).isNotNull()).groupBy(col(enu).alias("enumerator"))
            .agg(*[(F.avg(F.coalesce(col(f"Flag_{m}_Missing"), F.lit(0))) * F.lit(100.0)).alias(m) for m in mods]))
    return wide.unpivot(["enumerator"], mods, "module", "missing_pct")
