"""One partial-aggregate table behind the monitoring tables.

``build`` reads the flagged table once and keeps, for every enumerator, area and day, counts
of everything the tables show and exact sums of the scores.  Every measure is mergeable
(counts and sums add up, least and largest values compare), so

* a monitoring table is a second, small aggregation of this table: it scans no survey row;
* tables of batches that arrive one after the other merge into the table of all (``merge``);
* a hot enumerator is one partial row a task, as in any group-by.

Sums are order-independent: values enter as DECIMAL(20, 9), so a retried task, another
partitioning or a merge changes no bit of a mean or a deviation.  A value of 1e9 or more
is not summed so (its square has no such form); a mean over one is NULL.

The functions below take this table and give the same rows as their namesakes in
``monitor`` and ``deliver``, which read the flagged rows themselves.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import profile as P
from ..functions.columns import col, safe
from ..functions.context import Context
from ..plans.engine import any_flag, module_flag_columns, modules_in
from . import deliver as D
from . import monitor as M
from .checks import highest_tier

#: Scores with exact sums, by the column that holds them.
SCORES = ("FCS", "rCSI", "HDDS", "HHSize", "Timing_Duration_Min")
BANDS = ("Low", "Medium", "High")
FCG = ("Poor", "Borderline", "Acceptable")
TIERS = ("No coping", "Stress", "Crisis", "Emergency")
LCS_CODES = (P.LCS_NA, P.LCS_NOT_NEEDED, P.LCS_EXHAUSTED, P.LCS_APPLIED)
CELLS = [(h, r, f) for h in M.HHS_BANDS for r in M.RCSI_MATRIX_BANDS for f in M.FCG_LABELS]
EXACT = "DECIMAL(20, 9)"
DAY = "_day_"


# --- the table -------------------------------------------------------------------

def _keys(flagged: DataFrame, contexts: Iterable[Context]) -> tuple[list[str], list[str]]:
    """Context columns to group by, and the date columns whose day is a key."""
    contexts = list(contexts)
    return (list(dict.fromkeys(c for x in contexts for c in (x.enu, x.area) if c)),
            list(dict.fromkeys(x.date for x in contexts if x.date)))


def _exact(c: Column, name: str) -> list[Column]:
    """Number, sum and sum of squares of a value, and how many values are too large for them."""
    return [F.count(c).alias(f"n_{name}"), F.sum(c.try_cast(EXACT)).alias(f"s_{name}"),
            F.sum((c * c).try_cast("DECIMAL(28, 9)")).alias(f"q_{name}"),
            F.count_if(safe(F.abs(c) >= 1e9)).alias(f"over_{name}")]


def _measures(flagged: DataFrame) -> list[Column]:
    has, cnt = set(flagged.columns), lambda cond, name: F.count_if(safe(cond)).alias(name)
    out = [F.count(F.lit(1)).alias("n"), cnt(any_flag(flagged) == 1, "n_any")]
    for m in modules_in(flagged):
        out += [cnt(col(c) == 1, c) for c in [*module_flag_columns(flagged, m), f"Flag_{m}_Overall"]]
    if "FCG" in has:
        out += [F.count(col("FCG")).alias("n_fcg")] + [cnt(col("FCG") == x, f"fcg_{x}") for x in FCG]
    if "rCSI" in has:
        r = col("rCSI")
        out += [cnt(c, f"rcsi_{x}") for x, c in zip(BANDS, (r <= 3, (r >= 4) & (r <= 18), r >= 19))]
        out += [cnt(M.rcsi_severity(r) == x, f"severity_{x}") for x in BANDS]
    if "HDDS" in has:
        out += [cnt(M.hdds_band(col("HDDS")) == x, f"hdds_{x}") for x in BANDS]
    lcs = M.lcs_columns(flagged)
    if lcs:
        tier = highest_tier(set(lcs))
        out += [cnt(tier == x, f"tier_{i}") for i, x in enumerate(TIERS)]
        out += [cnt(col(c) == code, f"{c}__{code}") for c in lcs for code in LCS_CODES]
    out += [cnt(col(c).isNull(), f"null_{c}") for c in M.KEY_MISSING_COLUMNS if c in has]
    groups = M.fcs_groups_in(flagged)
    if groups:
        out.append(cnt(M.straight_line(groups), "straight"))
    if {"rCSI", "FCG"} <= has and any(c in has for c in P.HHS_COLUMNS):
        hb, rb = M.hhs_band(M.hhs_score([c for c in P.HHS_COLUMNS if c in has])), M.consistency_rcsi_band(col("rCSI"))
        out.append(cnt(hb.isNotNull() & rb.isNotNull(), "cell_total"))
        cell = F.concat_ws("|", hb, rb, col("FCG"))
        out += [cnt(cell == "|".join(c), f"cell_{i}") for i, c in enumerate(CELLS)]
    if "Timing_StartHour" in has:
        out += [cnt(F.floor(col("Timing_StartHour")) == h, f"hour_{h}") for h in range(24)]
    for c in SCORES:
        if c in has:
            out += _exact(col(c), c)
    if "Timing_Duration_Min" in has:
        d = col("Timing_Duration_Min")
        out += _exact(F.when((d > 0) & (d < 300), d), "valid")
    return out


def build(flagged: DataFrame, *contexts: Context) -> DataFrame:
    """The table: one row for each enumerator, area and day (of the columns that ``contexts`` name).

    The least (row, supervisor) pair of a group can't be kept in a hash table, and an aggregate
    that holds one sorts all rows of a task.  So the rows are aggregated by supervisor too, with
    the least row of each; only these few partial rows are merged with the pair."""
    keys, dates = _keys(flagged, contexts)
    by = [col(k).alias(k) for k in keys] + [M._day(flagged, d).alias(DAY + d) for d in dates]
    span = [f(M._moment(flagged, d)).alias(f"{k}_{d}") for d in dates for k, f in (("least", F.min), ("largest", F.max))]
    sup = next((x.sup for x in contexts if x.sup), None)
    if not sup:
        return flagged.groupBy(*by).agg(*_measures(flagged), *span)
    least = F.min(col("row_seq")).alias("_at")
    named = flagged.groupBy(*by, col(sup).cast("string").alias("_sup")).agg(*_measures(flagged), least, *span)
    first = F.when(col("_sup").isNotNull(), F.struct(col("_at").alias("row_seq"), col("_sup").alias("name"))).alias("first_supervisor")
    return merge(named.select(*[first if c == "_at" else col(c) for c in named.columns if c != "_sup"]))


def merge(*tables: DataFrame) -> DataFrame:
    """The table of all rows from tables of disjoint parts of them."""
    both = reduce(DataFrame.unionByName, tables)
    keys, out = [], []
    for f in both.schema.fields:
        c = col(f.name)
        if f.name.startswith(("least_", "first_supervisor")):
            out.append(F.min(c).alias(f.name))
        elif f.name.startswith("largest_"):
            out.append(F.max(c).alias(f.name))
        elif f.dataType.typeName() == "decimal":
            out.append(F.sum(c).cast(f.dataType).alias(f.name))
        elif f.dataType.typeName() == "long" and (f.name == "n" or f.name.startswith(_COUNTS) or "__" in f.name):
            out.append(F.sum(c).alias(f.name))
        else:
            keys.append(f.name)
    return both.groupBy(*[col(k) for k in keys]).agg(*out).select(*[col(c) for c in both.columns])


_COUNTS = ("n_", "Flag_", "fcg_", "rcsi_", "severity_", "hdds_", "tier_", "null_", "straight", "cell_", "hour_", "over_")


# --- reading it ------------------------------------------------------------------

def _sums(names: Sequence[str]) -> list[Column]:
    return [F.expr(f"coalesce(sum(`{n}`), 0L) AS `{n}`") for n in names]


def _by(facts: DataFrame, key: str, out: str, *aggs: Column) -> DataFrame:
    return facts.where(col(key).isNotNull()).groupBy(col(key).alias(out)).agg(*aggs)


def _mean(name: str) -> str:
    """SQL of a mean from its exact sum: NULL without values, or with one too large for it."""
    return f"IF(sum(over_{name}) = 0, try_divide(CAST(sum(s_{name}) AS DOUBLE), CAST(sum(n_{name}) AS DOUBLE)), NULL)"


def _deviation(name: str) -> str:
    """SQL of the sample standard deviation from exact sums."""
    n, s, q = f"CAST(sum(n_{name}) AS DOUBLE)", f"CAST(sum(s_{name}) AS DOUBLE)", f"CAST(sum(q_{name}) AS DOUBLE)"
    return f"IF(sum(over_{name}) = 0 AND sum(n_{name}) > 1, sqrt(greatest(({q} - {s} * {s} / {n}) / ({n} - 1), 0D)), NULL)"


def module_summary(facts: DataFrame) -> DataFrame:
    mods = modules_in(facts)
    one = facts.agg(*_sums(["n", *[f"Flag_{m}_Overall" for m in mods]]))
    long = one.select(F.col("n").alias("total"), *[col(f"Flag_{m}_Overall").alias(m) for m in mods]).unpivot(["total"], mods, "module", "flagged")
    rate = M._pct(F.col("flagged"), F.col("total"))
    return long.select("module", F.col("total").alias("total_records"), F.col("flagged").alias("flagged_records"),
                       rate.alias("flag_rate_pct"), M.rate_band_workbook(rate).alias("rate_band"))


def check_counts(facts: DataFrame) -> DataFrame:
    names = [(m, c) for m in modules_in(facts) for c in module_flag_columns(facts, m)]
    stack = ", ".join(f"'{m}', '{c[len(f'Flag_{m}_'):]}', `{c}`, {i}" for i, (m, c) in enumerate(names))
    return facts.agg(*_sums([c for _, c in names])).selectExpr(f"stack({len(names)}, {stack}) AS (module, check, n_flagged, check_pos)")


def top_checks(facts: DataFrame) -> DataFrame:
    return check_counts(facts).where("n_flagged > 0").orderBy(F.desc("n_flagged"), "check_pos")


def _header(facts: DataFrame, ctx: Context) -> DataFrame:
    date = M._need(ctx.date, "date")
    distinct = [F.count_distinct(col(c)).alias(k) if c else F.lit(0).cast("bigint").alias(k) for k, c in (("n_enumerators", ctx.enu), ("n_areas", ctx.area))]
    one = facts.agg(*_sums(["n"]), F.min(col(f"least_{date}")).alias("_lo"), F.max(col(f"largest_{date}")).alias("_hi"), *distinct)
    return one.selectExpr(
        "n", "to_date(_lo) AS date_min", "to_date(_hi) AS date_max",
        "CAST(coalesce(floor((unix_seconds(_hi) - unix_seconds(_lo)) / 86400) + 1, 0) AS BIGINT) AS days_active", "n_enumerators", "n_areas",
        "try_divide(CAST(n AS DOUBLE), CAST(greatest(n_enumerators, 1) AS DOUBLE)) AS surveys_per_enumerator")


def survey_header(facts: DataFrame, ctx: Context) -> DataFrame:
    return _header(facts, ctx)


def progress(facts: DataFrame, ctx: Context, target: int) -> DataFrame:
    return D.progress_of(_header(facts, ctx), target)


def daily_counts(facts: DataFrame, ctx: Context, target: int = 0) -> DataFrame:
    days = _by(facts, DAY + M._need(ctx.date, "date"), "date", *_sums(["n"]))
    w = Window.orderBy("date")  # on <= #days rows, after aggregation
    out = days.withColumn("cumulative", F.sum("n").over(w))
    if target > 0:
        n_days = F.count(F.lit(1)).over(Window.partitionBy())  # days
        out = out.withColumn("expected", F.lit(float(target)) / n_days * F.row_number().over(w))
    return out


def _labelled(facts: DataFrame, names: Sequence[str], labels: Sequence[str], *extra: str) -> DataFrame:
    stack = ", ".join(f"'{lab}', {i}, `{c}`" for i, (lab, c) in enumerate(zip(labels, names)))
    return facts.agg(*_sums([*names, *extra])).selectExpr(*extra, f"stack({len(labels)}, {stack}) AS (label, label_pos, n)")


def _share(n: str, den: str) -> str:
    return f"try_divide(CAST({n} AS DOUBLE), CAST({den} AS DOUBLE)) * 100.0D"


def fcg_dist(facts: DataFrame) -> DataFrame:
    out = _labelled(facts.withColumnRenamed("n", "n_rows"), [f"fcg_{x}" for x in FCG], FCG, "n_rows", "n_fcg")
    return out.selectExpr("label", "label_pos", "n", f"{_share('n', 'n_rows')} AS pct_all", f"{_share('n', 'n_fcg')} AS pct_classified")


def rcsi_dist(facts: DataFrame) -> DataFrame:
    out = _labelled(facts, [f"rcsi_{x}" for x in BANDS], BANDS, "n_rCSI")
    return out.selectExpr("label", "label_pos", "n", f"{_share('n', 'n_rCSI')} AS pct_scored")


def hdds_dist(facts: DataFrame) -> DataFrame:
    out = _labelled(facts, [f"hdds_{x}" for x in BANDS], BANDS, "n_HDDS")
    return out.selectExpr("label", "label_pos", "n", f"{_share('n', 'n_HDDS')} AS pct_scored")


def lcs_tier_dist(facts: DataFrame) -> DataFrame:
    out = _labelled(facts.withColumnRenamed("n", "n_rows"), [f"tier_{i}" for i in range(4)], TIERS, "n_rows")
    return out.selectExpr("label", "label_pos", "n", f"{_share('n', 'n_rows')} AS pct_all")


def score_means(facts: DataFrame) -> DataFrame:
    return facts.agg(*[F.expr(f"{_mean(c)} AS mean_{c.lower()}") for c in ("FCS", "rCSI", "HDDS")])


def surveys_per(facts: DataFrame, key: str, out_name: str) -> DataFrame:
    return _by(facts, key, out_name, F.sum("n").alias("surveys"))


def enumerator_completion(facts: DataFrame, ctx: Context, target: int) -> DataFrame:
    counts = surveys_per(facts, ctx.enu, "enumerator").withColumnRenamed("surveys", "completed")
    return D._completion(counts, "enumerator", target).orderBy(F.desc("completed"), "enumerator")


def area_completion(facts: DataFrame, ctx: Context, target: int) -> DataFrame:
    counts = surveys_per(facts, ctx.area, "area").withColumnRenamed("surveys", "completed")
    return D._completion(counts, "area", target).orderBy("pct_done", "area")


def straight_lining(facts: DataFrame, ctx: Context) -> DataFrame:
    return _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", F.sum("straight").alias("straight_line")).where("straight_line > 0")


def behaviour_totals(facts: DataFrame) -> DataFrame:
    odd = [f"cell_{i}" for i, (h, r, f) in enumerate(CELLS) if h in ("2-3", "4", "5-6") and r == "<4" and f != "Poor"]
    one = facts.agg(F.expr("coalesce(sum(straight), 0L) AS straight_line") if "straight" in facts.columns else F.lit(0).cast("bigint").alias("straight_line"),
                    F.expr("coalesce(sum(cell_total), 0L) AS total"), F.expr(f"coalesce(sum({' + '.join(odd)}), 0L) AS illogical"))
    return one.selectExpr("*", f"{_share('illogical', 'total')} AS illogical_pct")


def missing_pct_by_enumerator(facts: DataFrame, ctx: Context) -> DataFrame:
    keys = [c for c in M.KEY_MISSING_COLUMNS if f"null_{c}" in facts.columns]
    parts = " + ".join(f"CAST(sum(`null_{c}`) AS DOUBLE) / CAST(sum(n) AS DOUBLE)" for c in keys)
    return _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", F.expr(f"({parts}) / {float(len(keys))}D * 100.0D AS missing_pct"))


def valid_duration_by_enumerator(facts: DataFrame, ctx: Context) -> DataFrame:
    return _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", F.expr(f"{_mean('valid')} AS avg_duration_min"),
               F.sum("n_valid").alias("n_valid")).where("n_valid > 0")


def enumerator_deviation(facts: DataFrame, ctx: Context) -> DataFrame:
    """As in ``monitor``, from exact sums: means and deviations don't depend on any order."""
    metrics = {k: v for k, v in M.DEVIATION_METRICS.items() if f"s_{v}" in facts.columns}
    whole = facts.agg(F.struct(*[F.expr(f"{x} AS {side}_{k}") for k, v in metrics.items() for side, x in (
        ("o", _mean(v)), ("d", _deviation(v)))]).alias("w")).scalar()
    wide = _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", *[F.expr(f"{_mean(v)} AS m_{k}") for k, v in metrics.items()]).withColumn("w", whole)
    stack = ", ".join(f"'{k}', m_{k}, w.o_{k}, w.d_{k}" for k in metrics)
    long = wide.selectExpr("enumerator", f"stack({len(metrics)}, {stack}) AS (metric, mean, overall_mean, overall_sd)")
    # the mean is compared as displayed (2 decimals)
    return long.selectExpr("*", "coalesce(overall_sd <> 0 AND mean IS NOT NULL AND abs(bround(mean, 2) - overall_mean) > 1.5D * overall_sd, false) AS deviates")


def submission_matrix(facts: DataFrame, ctx: Context) -> DataFrame:
    enu, day = M._need(ctx.enu, "enumerator"), DAY + M._need(ctx.date, "date")
    return facts.where(col(enu).isNotNull() & col(day).isNotNull()).groupBy(col(enu).alias("enumerator"), col(day).alias("date")).agg(F.sum("n").alias("n"))


def category_share(facts: DataFrame, group: str, band: str, labels: Sequence[str], top_n: int | None = None) -> DataFrame:
    """G22 (+W5) for a band counted as ``<band>_<label>``; its labels cover every band."""
    names = [f"{band}_{x}" for x in labels]
    wide = _by(facts, group, "group", F.expr(f"sum({' + '.join(names)}) AS n_group"), F.sum("n").alias("_size"), *_sums(names))
    if top_n:
        wide = wide.orderBy(F.desc("_size"), "group").limit(top_n)  # W5: a top-n report
    stack = ", ".join(f"'{lab}', {i}, `{c}`" for i, (lab, c) in enumerate(zip(labels, names)))
    return wide.where("n_group > 0").selectExpr("group", "n_group", f"stack({len(labels)}, {stack}) AS (label, label_pos, n)") \
        .selectExpr("*", f"{_share('n', 'n_group')} AS pct")


def fcg_share(facts: DataFrame, group: str, top_n: int | None = None) -> DataFrame:
    return category_share(facts, group, "fcg", FCG, top_n)


def rcsi_share(facts: DataFrame, group: str, top_n: int | None = None) -> DataFrame:
    return category_share(facts, group, "severity", BANDS, top_n)


def mean_by(facts: DataFrame, key: str, score: str) -> DataFrame:
    return _by(facts, key, "group", F.expr(f"{_mean(score)} AS mean"), F.sum(f"n_{score}").alias("n")).where("n > 0").orderBy("mean", "group")


def score_trend(facts: DataFrame, ctx: Context) -> DataFrame:
    return _by(facts, DAY + M._need(ctx.date, "date"), "date", *[F.expr(f"{_mean(c)} AS mean_{c.lower()}") for c in ("FCS", "rCSI", "HDDS")])


def _strategies(facts: DataFrame) -> list[str]:
    return list(dict.fromkeys(c.rsplit("__", 1)[0] for c in facts.columns if c.startswith("Lcs_") and "__" in c))


def lcs_response_dist(facts: DataFrame) -> DataFrame:
    cells = [(c, code) for c in _strategies(facts) for code in LCS_CODES]
    stack = ", ".join(f"'{c}', '{M.lcs_tier_of(c)}', {code}, `{c}__{code}`" for c, code in cells)
    one = facts.withColumnRenamed("n", "n_rows").agg(*_sums(["n_rows", *[f"{c}__{code}" for c, code in cells]]))
    return one.selectExpr("n_rows", f"stack({len(cells)}, {stack}) AS (strategy, tier, code, n)") \
        .selectExpr("strategy", "tier", "code", "n", f"{_share('n', 'n_rows')} AS pct")


def lcs_na_rate(facts: DataFrame, ctx: Context) -> DataFrame:
    cols = _strategies(facts)
    rates = [F.expr(f"CAST(sum(`{c}__{P.LCS_NA}`) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100.0D AS r{i}") for i, c in enumerate(cols)]
    stack = ", ".join(f"'{c}', '{M.lcs_tier_of(c)}', r{i}" for i, c in enumerate(cols))
    long = _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", *rates).selectExpr("enumerator", f"stack({len(cols)}, {stack}) AS (strategy, tier, na_pct)")
    return long.withColumn("na_invalid", F.col("tier") == "Emergency")


def start_hour_hist(facts: DataFrame, ctx: Context) -> DataFrame:
    names = [f"hour_{h}" for h in range(24)]
    stack = ", ".join(f"{h}, hour_{h}" for h in range(24))
    return _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", *_sums(names)) \
        .selectExpr("enumerator", f"stack(24, {stack}) AS (hour, n)").where("n > 0")


def consistency_matrix(facts: DataFrame) -> DataFrame:
    one = facts.agg(*_sums(["cell_total", *[f"cell_{i}" for i in range(len(CELLS))]]))
    stack = ", ".join(f"'{h}', '{r}', '{f}', cell_{i}" for i, (h, r, f) in enumerate(CELLS))
    return one.selectExpr("cell_total AS total", f"stack({len(CELLS)}, {stack}) AS (hhs_band, rcsi_band, fcg, n)").selectExpr(
        "hhs_band", "rcsi_band", "fcg", "n", "total", f"{_share('n', 'total')} AS pct",
        "hhs_band IN ('2-3', '4', '5-6') AND fcg IN ('Acceptable', 'Borderline') AND rcsi_band = '<4' AS illogical")


def missing_rate_matrix(facts: DataFrame, ctx: Context) -> DataFrame:
    mods = [m for m in modules_in(facts) if f"Flag_{m}_Missing" in facts.columns]
    rates = [F.expr(f"CAST(sum(`Flag_{m}_Missing`) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 100.0D AS `{m}`") for m in mods]
    return _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", *rates).unpivot(["enumerator"], mods, "module", "missing_pct")


def enumerator_feedback(facts: DataFrame, ctx: Context) -> DataFrame:
    out = _by(facts, ctx.enu, "enumerator", F.sum("n").alias("total_surveys"), F.sum("n_any").alias("flagged_records"))
    return out.selectExpr("*", "flagged_records / total_surveys * 100.0D AS flag_rate_pct").orderBy(F.desc("flag_rate_pct"), "enumerator")


def first_supervisor(facts: DataFrame, ctx: Context) -> DataFrame:
    """The supervisor of each enumerator's first row that names one."""
    return _by(facts, M._need(ctx.enu, "enumerator"), "enumerator", F.min("first_supervisor").alias("_f")).select("enumerator", F.col("_f.name").alias("supervisor"))
