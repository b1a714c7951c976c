"""Flag counts of the derived survey equal the regression anchors of FIXTURES.md §4."""
import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from fieldlens import profile as P
from fieldlens.operators import monitor as M
from fieldlens.plans import registry as R
from fieldlens.plans.engine import any_flag

# FIXTURES.md §4, columns sf0.001 and sf0.01.
ANCHORS = {
    "FCS_Missing": (7, 76), "FCS_Erroneous": (10, 67), "FCS_Identical": (35, 398), "FCS_LowStaple": (12, 124),
    "FCS_Low": (14, 122), "FCS_High": (0, 0),
    "rCSI_Missing": (5, 35), "rCSI_Erroneous": (6, 37), "rCSI_Identical": (5, 28), "rCSI_ZeroWithPoorFCG": (20, 152),
    "rCSI_HighWithAcceptFCG": (16, 104), "rCSI_AdultMealNoChildren": (25, 148),
    "HDDS_Missing": (3, 28), "HDDS_Erroneous": (1, 28), "HDDS_Low": (12, 108), "HDDS_AllGroups": (20, 162),
    "Demo_Missing": (3, 31), "Demo_Erroneous": (3, 34), "Demo_HighHHSize": (7, 62), "Demo_SumMismatch": (31, 222),
    "Demo_NoAdults": (9, 126), "Demo_PLWExceeds": (21, 159),
    "LCS_Missing": (4, 25), "LCS_Erroneous": (4, 30), "LCS_ChildStratNoChildren": (10, 105),
    "LCS_AllNA_PoorFood": (31, 273), "LCS_NonSequential": (22, 245), "LCS_ManyNA": (32, 293),
    "Housing_Missing": (8, 48), "Housing_Erroneous": (3, 47), "Housing_DisplacedOwner": (6, 107),
    "HHExpF_Missing": (7, 52), "HHExpF_Erroneous": (7, 60), "HHExpF_ZeroTotal": (8, 65),
    "HHExpF_BelowMinPrice": (18, 185), "HHExpF_ExtremeItem": (7, 51),
    "HHExpNF1M_Missing": (8, 47), "HHExpNF1M_Erroneous": (7, 48), "HHExpNF1M_ZeroTotal": (7, 64),
    "HHExpNF1M_BelowMinPrice": (20, 154), "HHExpNF1M_ExtremeItem": (7, 49),
    "HHExpNF6M_Missing": (8, 48), "HHExpNF6M_Erroneous": (8, 56), "HHExpNF6M_ZeroTotal": (6, 69),
    "HHExpNF6M_BelowMinPrice": (19, 166), "HHExpNF6M_ExtremeItem": (7, 56),
    "Timing_Missing": (8, 61), "Timing_Erroneous": (5, 36), "Timing_InvalidDuration": (6, 37),
    "Timing_ShortDuration": (33, 278), "Timing_LongDuration": (82, 827), "Timing_AbnormalHour": (8, 60),
}
FCG = {"Poor": (249, 2441), "Borderline": (63, 692), "Acceptable": (671, 6724)}
OTHER = {"dup_rows": (40, 400), "straight": (36, 424), "illogical": (18, 167), "null_enu": (5, 48),
         "any_flag": (483, 3893), "rows": (1000, 10000), "fcs_high_100": (12, 144)}


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def case(request, spark):
    idx = 0 if request.param == "0.001" else 1
    return idx, R.flagged(spark, sf_dir(request.param)), request.param


def test_check_counts(case):
    idx, f, _ = case
    got = {f"{r['module']}_{r['check']}": r["n_flagged"] for r in M.check_counts(f).collect()}
    for name, expected in ANCHORS.items():
        assert got[name] == expected[idx], name


def test_fcg_of_passing_rows(case):
    idx, f, _ = case
    ok = f.where((F.col("Flag_FCS_Missing") == 0) & (F.col("Flag_FCS_Erroneous") == 0))
    got = {r["FCG"]: r["n"] for r in ok.groupBy("FCG").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label, expected in FCG.items():
        assert got[label] == expected[idx], label


def test_other_anchors(case, spark):
    idx, f, sf = case
    hhs = F.col("HHSBedHung") + F.col("HHSNoFood") + F.col("HHSNotEat")
    row = f.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("EnuName").isNull()).alias("null_enu"),
        F.count_if(any_flag(f) == 1).alias("any_flag"),
        F.count_if(M.straight_line(M.fcs_groups_in(f))).alias("straight"),
        F.count_if((hhs >= 2) & (F.col("rCSI") <= 3) & (F.col("FCG") != "Poor")).alias("illogical"),
    ).first()
    dup = M.duplicate_ids(f, R._dash(f)).agg(F.sum("n_rows")).first()[0]
    assert dup == OTHER["dup_rows"][idx]
    for k in ("rows", "null_enu", "any_flag", "straight", "illogical"):
        assert row[k] == OTHER[k][idx], k
    dash = R.QUERIES["fcs_flags_dashboard"](spark, sf_dir(sf))
    assert dash.where("Flag_FCS_High = 1").count() == OTHER["fcs_high_100"][idx]


def test_enumerator_rates_sf01(spark):
    """FIXTURES.md §4: row-level any-flag rate by enumerator at sf0.1 and the duration figures."""
    f = R.flagged(spark, sf_dir("0.1"))
    rates = {r["enumerator"]: r["flag_rate_pct"] for r in
             __import__("fieldlens.operators.deliver", fromlist=["x"]).enumerator_feedback(f, R._dash(f)).collect()}
    expected = {"ENU_0": 58.2, "ENU_1": 59.9, "ENU_2": 59.6, "ENU_3": 59.5, "ENU_4": 11.8, "ENU_5": 41.4,
                "ENU_6": 11.7, "ENU_7": 100.0, "ENU_8": 11.7, "ENU_9": 12.4, "ENU_10": 11.6, "ENU_11": 11.6}
    for k, v in expected.items():
        assert round(rates[k], 1) == v, k
    d = f.agg(F.avg("Timing_Duration_Min"), F.stddev_samp("Timing_Duration_Min")).first()
    assert round(d[0], 2) == 77.88 and round(d[1], 2) == 58.85
    enu7 = f.where("EnuName = 'ENU_7'").agg(F.avg("Timing_Duration_Min")).first()[0]
    assert round(enu7, 1) == 235.8
