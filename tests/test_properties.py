from functools import reduce

from pyspark.sql import functions as F

from conftest import sf_dir
from fieldlens import profile as P
from fieldlens import run_checks
from fieldlens.operators import monitor as M
from fieldlens.plans import registry as R
from fieldlens.plans.engine import module_flag_columns, modules_in


def test_rollup_is_max_and_gate_nulls(spark):
    f = R.flagged(spark, sf_dir("0.001"))
    for m in modules_in(f):
        flags = module_flag_columns(f, m)
        mx = F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in flags])
        assert f.where(F.col(f"Flag_{m}_Overall") != mx).count() == 0, m
        ungated = [c for c in flags if not c.endswith(("_Missing", "_Erroneous", "_ShortDuration"))]
        open_ = (F.col(f"Flag_{m}_Missing") == 0) & (F.col(f"Flag_{m}_Erroneous") == 0)
        for c in ungated:
            assert f.where(F.col(c).isNull() == open_).count() == 0, c
        assert f.where(F.col(f"Flag_{m}_Erroneous").isNull() != (F.col(f"Flag_{m}_Missing") == 1)).count() == 0


def test_group_counts_and_shares(spark):
    f = R.flagged(spark, sf_dir("0.001"))
    ctx = R._dash(f)
    n = f.count()
    nulls = f.where(F.col(ctx.enu).isNull()).count()
    assert M.surveys_per(f, ctx.enu, "e").agg(F.sum("surveys")).first()[0] == n - nulls
    shares = M.fcg_share_by_area(f, ctx).groupBy("group").agg(F.sum("pct").alias("s")).collect()
    assert all(abs(r.s - 100.0) < 1e-9 for r in shares)
    dist = M.lcs_tier_dist(f).agg(F.sum("n")).first()[0]
    assert dist == n


def test_invariant_to_repartitioning(spark):
    s = R.survey(spark, sf_dir("0.001"))
    a = run_checks(s, P.fixture()).select("row_seq", "Flag_LCS_Overall", "Flag_Timing_Narrative")
    b = run_checks(s.repartition(5, "EnuName"), P.fixture()).select("row_seq", "Flag_LCS_Overall", "Flag_Timing_Narrative")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_narrative_text(spark):
    f = R.flagged(spark, sf_dir("0.001"))
    clean = f.where("Flag_FCS_Overall = 0").select("Flag_FCS_Narrative").distinct().collect()
    assert [r[0] for r in clean] == ["No issues found"]
    row = f.where("Flag_Timing_ShortDuration = 1").select("Flag_Timing_Narrative").first()[0]
    assert row.startswith("Short interview: ") and "min, under 10" in row
    parts = reduce(lambda a, b: a | b, [F.col("Flag_Demo_Narrative").contains("Missing answers: HHSize")])
    assert f.where(parts & (F.col("Flag_Demo_Missing") == 0)).count() == 0


def _percentiles(df, group, value, probs):
    ref = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("p")).collect()
    return {r[group]: (r.n, list(r.p)) for r in ref}


def _ours(df, group, value, probs, **more):
    from fieldlens.operators.quantiles import exact_quantiles
    names = [f"p{i}" for i in range(len(probs))]
    return {r[group]: (r.n, [r[n] for n in names]) for r in exact_quantiles(df, group, value, probs, names, **more).collect()}


PROBS = [0.0, 0.1, 0.5, 0.9, 1.0]


def test_exact_quantiles_with_a_hot_group(spark):
    """A group holding a third of all rows; same numbers as percentile, without one big group map."""
    from fieldlens.operators.quantiles import exact_quantiles
    f = R.flagged(spark, sf_dir("0.01"))
    skew = f.withColumn("grp", F.when(F.col("row_seq") % 3 == 0, F.lit("HOT")).otherwise(F.col("ADMIN1Name")))
    for value, accuracy in (("Timing_Duration_Min", 1000), ("HHExpFCer_Purch_MN_7D", 50)):
        assert _ours(skew, "grp", value, PROBS, accuracy=accuracy) == _percentiles(skew, "grp", value, PROBS), value
    for accuracy in (20, 1000):
        whole = exact_quantiles(f, None, "Timing_Duration_Min", [0.5], ["m"], accuracy=accuracy).first().m
        assert whole == f.agg(F.median("Timing_Duration_Min")).first()[0]
    assert exact_quantiles(f.limit(0), None, "FCS", [0.5]).count() == 0


def _magnitudes(spark, n=120_000):
    """A third of the rows each below 1e3, around 1e9 and around 1e15, nearly all distinct, and a
    group of one value."""
    i = F.col("id")
    spread = F.pmod(F.xxhash64(i), F.lit(1_000_000)).cast("double")
    v = F.when(i % 3 == 0, spread / 1000).when(i % 3 == 1, spread * 1000 + 1).otherwise(spread * 1e9 + 7)
    return spark.range(n).select(F.when(i % 5 < 3, "hot").when(i % 50 == 3, "one").otherwise("rest").alias("g"),
                                 F.when(i % 50 == 3, 42.0).otherwise(v).alias("v"))


def test_exact_quantiles_over_magnitudes_stay_bounded(spark, monkeypatch):
    """However the values are spread, no group keeps more than the set number of them."""
    from fieldlens.operators import quantiles as Q
    df, kept = _magnitudes(spark), []
    real = Q._interpolated
    monkeypatch.setattr(Q, "_interpolated", lambda t, *a: (kept.append(
        t.where("_in").groupBy("_g", "_s").count().agg(F.max("count")).first()[0]), real(t, *a))[1])
    want = _percentiles(df, "g", "v", PROBS)
    for accuracy, most in ((1000, 200_000), (1000, 300), (30, 2000), (30, 50)):
        assert _ours(df, "g", "v", PROBS, accuracy=accuracy, most=most) == want
        assert kept.pop() <= most and not kept
    # one pass already leaves a few sketch errors' worth of values, not a share of the table
    _ours(df, "g", "v", [0.5])
    assert kept.pop() <= 6 * 72_000 / 1000


def test_wrong_splitters_are_noticed(spark, monkeypatch):
    """Pairs that miss the wanted rank are set wider until they hold it."""
    from fieldlens.operators import quantiles as Q
    df, real, margins = _magnitudes(spark, 30_000), Q._splitters, []

    def off(base, probs, accuracy, margin):
        margins.append(margin)
        return real(base, [min(1.0, max(0.0, p + 0.2)) if 0 < p < 1 else p for p in probs], accuracy, margin)

    monkeypatch.setattr(Q, "_splitters", off)
    assert _ours(df, "g", "v", [0.25, 0.5], accuracy=100) == _percentiles(df, "g", "v", [0.25, 0.5])
    assert len(margins) > 1
