"""Hand-made edge rows (FIXTURES.md §5) on tiny DataFrames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldlens import profile as P
from fieldlens import run_checks
from fieldlens.functions.context import resolve_context
from fieldlens.operators import monitor as M
from fieldlens.sources.survey import coerce_types

FCS = list(P.FCS_GROUPS)


def fcs_rows(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FCS))


def test_fcg_boundaries(spark):
    # weights 2,3,4,4,1,1,.5,.5 -> choose answers giving FCS 20.5, 21, 34.5, 35
    rows = [(0.0, 0.0, 0.0, 0.0, 7.0, 7.0, 7.0, 6.0), (0.0, 0.0, 0.0, 0.0, 7.0, 7.0, 7.0, 7.0),
            (3.0, 3.0, 0.0, 0.0, 7.0, 7.0, 4.0, 7.0), (0.0, 0.0, 0.0, 7.0, 7.0, 0.0, 0.0, 0.0)]
    out = run_checks(fcs_rows(spark, rows), P.batch(), only=["FCS"]).select("FCS", "FCG").collect()
    assert [(r.FCS, r.FCG) for r in out] == [(20.5, "Poor"), (21.0, "Borderline"), (34.5, "Borderline"),
                                            (35.0, "Acceptable")]


def test_text_coercion(spark):
    df = spark.createDataFrame([("x",), ("5d",), ("nan",), (" 6 ",), ("1e2",), ("",), ("1,000",)], "FCSStap string")
    got = [r.FCSStap for r in coerce_types(df).collect()]
    assert got == [None, None, None, 6.0, 100.0, None, None]


def test_nan_becomes_null(spark):
    df = fcs_rows(spark, [(float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    r = run_checks(df, P.batch(), only=["FCS"]).first()
    assert r.FCSStap is None and r.Flag_FCS_Missing == 1 and r.Flag_FCS_Erroneous is None and r.Flag_FCS_Low is None


def test_missing_optional_and_absent_module(spark):
    cols = ["HHSize"] + list(P.DEMO_MALE + P.DEMO_FEMALE)  # no HHPregLactNb, no FCS columns at all
    df = spark.createDataFrame([tuple([2.0] + [0.0] * 4 + [1.0, 0.0] + [0.0] * 4 + [1.0, 0.0])],
                               ", ".join(f"{c} double" for c in cols))
    out = run_checks(df, P.batch(), only=["Demo", "FCS", "rCSI"])
    assert "Flag_Demo_PLWExceeds" not in out.columns
    assert "FCS" not in out.columns and "FCG" not in out.columns
    assert not [c for c in out.columns if c.startswith("Flag_FCS_") and c.split("_")[-1] in ("Low", "High", "Identical")]
    assert "Flag_rCSI_ZeroWithPoorFCG" not in out.columns
    r = out.first()
    assert r.Flag_Demo_Missing == 0 and r.Flag_Demo_Erroneous == 0 and r.Flag_Demo_Overall == 0
    assert r.Flag_FCS_Missing == 0 and r.Flag_FCS_Overall == 0


def test_single_fcs_answer_has_no_identical_check(spark):
    df = spark.createDataFrame([(3.0,)], "FCSStap double")
    out = run_checks(df, P.batch(), only=["FCS"])
    assert "Flag_FCS_Identical" not in out.columns
    assert out.first().FCS == 6.0


def _timing(spark, start, end, offset=0):
    df = spark.createDataFrame([(start, end)], "start timestamp_ntz, end timestamp_ntz")
    prof = P.batch().with_overrides({"Timing": {"utc_offset_hours": offset}})
    return run_checks(df, prof, only=["Timing"]).first()


def test_end_equals_start(spark):
    t = dt.datetime(2024, 1, 1, 9, 0)
    r = _timing(spark, t, t)
    assert r.Timing_Duration_Min == 0.0
    assert r.Flag_Timing_InvalidDuration == 1 and r.Flag_Timing_ShortDuration is None
    assert r.Flag_Timing_Erroneous == 0


def test_end_before_start_is_erroneous(spark):
    r = _timing(spark, dt.datetime(2024, 1, 1, 9, 0), dt.datetime(2024, 1, 1, 8, 50))
    assert r.Flag_Timing_Erroneous == 1 and r.Flag_Timing_InvalidDuration is None


def test_fractional_offset(spark):
    r = _timing(spark, dt.datetime(2024, 1, 1, 20, 45), dt.datetime(2024, 1, 1, 21, 30), offset=5.5)
    assert r.Timing_StartHour == 1.5  # hour truncated first: (20 + 5.5) mod 24
    assert r.Flag_Timing_AbnormalHour == 1
    r = _timing(spark, dt.datetime(2024, 1, 1, 3, 0), dt.datetime(2024, 1, 1, 3, 30), offset=-5)
    assert r.Timing_StartHour == 22.0


def test_expenditure_all_null_vs_all_zero(spark):
    cols = ["HHExpFCer_Purch_MN_7D", "HHExpFOil_Purch_MN_7D"]
    df = spark.createDataFrame([(None, None), (0.0, 0.0), (0.0, None), (-1.0, 3.0)], ", ".join(f"{c} double" for c in cols))
    prof = P.batch().with_overrides({"HHExpF": {"min_item_price": 5}})
    out = run_checks(df, prof, only=["HHExpF"]).orderBy(F.monotonically_increasing_id()).collect()
    assert [r.Flag_HHExpF_Missing for r in out] == [1, 0, 0, 0]
    assert [r.Flag_HHExpF_ZeroTotal for r in out] == [None, 1, 1, None]
    assert [r.Flag_HHExpF_Erroneous for r in out] == [None, 0, 0, 1]
    assert out[2].Flag_HHExpF_BelowMinPrice == 0


def test_raw_score_column_is_kept_aside(spark):
    df = fcs_rows(spark, [(1.0,) * 8]).withColumn("FCS", F.lit(999.0))
    r = run_checks(df, P.batch(), only=["FCS"]).first()
    assert r.FCS == 16.0 and r.FCS_input == 999.0


def test_shared_id_and_null_enumerator(spark):
    rows = [("a", "E1", 1), ("a", "E2", 0), ("b", "E2", 0), ("c", None, 1)]
    df = spark.createDataFrame(rows, "_uuid string, EnuName string, Flag_X_Overall int") \
        .withColumn("row_seq", F.monotonically_increasing_id())
    # flag rate by enumerator counts distinct flagged ids; id 'a' flagged under E1 counts for E2 too
    from fieldlens.profile import MODULE_ORDER  # noqa: F401
    ctx = resolve_context(df.columns, "report")
    pairs = df.withColumnRenamed("Flag_X_Overall", "Flag_Demo_Overall")
    got = {r.enumerator: (r.surveys, r.flagged) for r in M.flag_rate_by_enumerator(pairs, ctx).collect()}
    assert got == {"E1": (1, 1), "E2": (2, 1)}


def test_hhs_all_null_band(spark):
    df = spark.createDataFrame([(None, None, None)], "HHSBedHung double, HHSNoFood double, HHSNotEat double")
    r = df.select(M.hhs_band(M.hhs_score(list(P.HHS_COLUMNS))).alias("b")).first()
    assert r.b == "0"


def test_context_resolvers():
    cols = ["_uuid", "EnuName", "EnuSupervisorName", "ADMIN1Name", "ADMIN2Name", "today"]
    d = resolve_context(cols, "dashboard")
    assert (d.hhid, d.enu, d.sup, d.area, d.date) == ("_uuid", "EnuName", "EnuSupervisorName", "ADMIN2Name", "today")
    r = resolve_context(cols, "report")
    assert (r.hhid, r.enu, r.area, r.date) == ("_uuid", "EnuName", "ADMIN1Name", "today")
    assert resolve_context(["my_enumerator_x", "district_code"], "dashboard").enu == "my_enumerator_x"


def test_profile_layers():
    p = P.dashboard()
    assert p.t("FCS", "high_fcs_threshold") == 100 and p.t("Timing", "short_duration_min") == 20
    assert P.batch().t("FCS", "high_fcs_threshold") == 112
    with pytest.raises(KeyError):
        P.batch().with_overrides({"FCS": {"nope": 1}})
    with pytest.raises(KeyError):
        P.batch().select(only=["Nope"])
    assert P.batch().select(skip=["LCS"]).enabled == tuple(m for m in P.MODULE_ORDER if m != "LCS")


def test_present_and_pivot(spark):
    from fieldlens.operators import deliver as D
    df = spark.createDataFrame([(0.25, 1.0, 12.345)], "a double, Flag_X double, b double")
    r = D.present(df).first()
    assert r.a == 0.2 and r.Flag_X == 1 and r.b == 12.3
    m = spark.createDataFrame([("E1", "2024-01-01"), ("E1", "2024-01-02"), ("E2", "2024-01-02")],
                              "EnuName string, today string").withColumn("today", F.to_date("today"))
    ctx = resolve_context(m.columns, "dashboard")
    wide = {r.enumerator: (r["2024-01-01"], r["2024-01-02"]) for r in D.submission_pivot(m, ctx, ["2024-01-01", "2024-01-02"]).collect()}
    assert wide == {"E1": (1, 1), "E2": (0, 1)}
