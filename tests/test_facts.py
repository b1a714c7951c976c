"""The partial-aggregate table: same rows as the tables built from the survey itself."""
import math

import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from fieldlens import profile as P
from fieldlens.functions.context import resolve_context
from fieldlens.operators import deliver as D
from fieldlens.operators import facts as A
from fieldlens.operators import monitor as M
from fieldlens.plans import registry as R
from fieldlens.plans.materialize import materialize


@pytest.fixture(scope="module")
def survey(spark):
    """A third of the rows under one enumerator, some keys and scores NULL, uneven minutes."""
    f = R.flagged(spark, sf_dir("0.001"))
    third = F.col("row_seq") % 3 == 0
    return f.withColumns({"EnuName": F.when(third, "HOT").when(F.col("row_seq") % 17 == 0, None).otherwise(F.col("EnuName")),
                          "ADMIN2Name": F.when(F.col("row_seq") % 13 != 0, F.col("ADMIN2Name")),
                          "today": F.when(F.col("row_seq") % 19 != 0, F.col("today")),
                          "Timing_Duration_Min": F.col("Timing_Duration_Min") + (F.col("row_seq") % 7) / F.lit(7.0)})


@pytest.fixture(scope="module")
def dash(survey):
    return resolve_context(survey.columns, "dashboard")


@pytest.fixture(scope="module")
def facts(spark, survey, dash):
    return materialize(spark, lambda: A.build(survey, dash, resolve_context(survey.columns, "report")), "facts-test", rebuild=True)


def rows(df):
    """Rows in any order, doubles to 6 digits: the tables of the survey add doubles."""
    show = lambda v: None if v is None else round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return sorted([tuple((c, show(r[c])) for c in sorted(df.columns)) for r in df.collect()], key=str)


PAIRS = {
    "module_summary": lambda f, c, T: T.module_summary(f), "check_counts": lambda f, c, T: T.check_counts(f),
    "top_checks": lambda f, c, T: T.top_checks(f), "survey_header": lambda f, c, T: T.survey_header(f, c),
    "daily_counts": lambda f, c, T: T.daily_counts(f, c, 500), "fcg_dist": lambda f, c, T: T.fcg_dist(f),
    "rcsi_dist": lambda f, c, T: T.rcsi_dist(f), "hdds_dist": lambda f, c, T: T.hdds_dist(f), "lcs_tier_dist": lambda f, c, T: T.lcs_tier_dist(f),
    "score_means": lambda f, c, T: T.score_means(f), "surveys_per": lambda f, c, T: T.surveys_per(f, c.area, "area"),
    "straight_lining": lambda f, c, T: T.straight_lining(f, c), "behaviour_totals": lambda f, c, T: T.behaviour_totals(f),
    "missing_pct": lambda f, c, T: T.missing_pct_by_enumerator(f, c), "valid_duration": lambda f, c, T: T.valid_duration_by_enumerator(f, c),
    "deviation": lambda f, c, T: T.enumerator_deviation(f, c), "matrix": lambda f, c, T: T.submission_matrix(f, c),
    "mean_by": lambda f, c, T: T.mean_by(f, c.area, "HDDS"), "trend": lambda f, c, T: T.score_trend(f, c),
    "lcs_responses": lambda f, c, T: T.lcs_response_dist(f), "lcs_na": lambda f, c, T: T.lcs_na_rate(f, c),
    "hours": lambda f, c, T: T.start_hour_hist(f, c), "consistency": lambda f, c, T: T.consistency_matrix(f),
    "missing_matrix": lambda f, c, T: T.missing_rate_matrix(f, c),
}


@pytest.mark.parametrize("name", PAIRS)
def test_same_rows_as_from_the_survey(survey, facts, dash, name):
    assert rows(PAIRS[name](facts, dash, A)) == rows(PAIRS[name](survey, dash, M))


def test_shares_completion_and_feedback(survey, facts, dash):
    assert rows(A.fcg_share(facts, dash.area, 3)) == rows(M.fcg_share_by_area(survey, dash, 3))
    assert rows(A.rcsi_share(facts, dash.enu)) == rows(M.rcsi_share_by_enumerator(survey, dash))
    assert rows(A.enumerator_completion(facts, dash, 90)) == rows(D.enumerator_completion(survey, dash, 90))
    assert rows(A.area_completion(facts, dash, 90)) == rows(D.area_completion(survey, dash, 90))
    assert rows(A.progress(facts, dash, 90)) == rows(D.progress(survey, dash, 90))
    assert rows(A.enumerator_feedback(facts, dash)) == rows(D.enumerator_feedback(survey, dash))
    sup = M.enumerator_scorecard(survey, dash).where("supervisor IS NOT NULL").select("enumerator", "supervisor")
    assert rows(A.first_supervisor(facts, dash).where("supervisor IS NOT NULL")) == rows(sup)


def _bits(facts, dash):
    """Means and deviations as they are, to the last bit."""
    return sorted(map(tuple, A.enumerator_deviation(facts, dash).collect())), sorted(map(tuple, A.score_trend(facts, dash).collect()), key=str)


def test_sums_depend_on_no_order(survey, facts, dash):
    """Other partitions, another order and a merge of three parts change no bit."""
    want = _bits(facts, dash)
    assert _bits(A.build(survey.orderBy(F.desc("FCS"), "row_seq").repartition(7), dash), dash) == want
    parts = [A.build(survey.where(F.col("row_seq") % 3 == k), dash, resolve_context(survey.columns, "report")) for k in range(3)]
    merged = A.merge(*parts)
    assert merged.columns == facts.columns and merged.dtypes == facts.dtypes
    assert _bits(merged, dash) == want
    assert sorted(map(str, merged.collect())) == sorted(map(str, facts.collect()))


def test_a_value_without_an_exact_form_has_no_mean(spark, survey, dash):
    far = survey.withColumn("HHSize", F.when(F.col("EnuName") == "HOT", 1e300).otherwise(F.col("HHSize")))
    means = {(r.enumerator, r.metric): r.mean for r in A.enumerator_deviation(A.build(far, dash), dash).collect()}
    assert means[("HOT", "HHSize")] is None and means[("HOT", "FCS")] is not None
    assert all(v is not None for (e, m), v in means.items() if e != "HOT")


def test_registered_tables_scan_no_survey(spark):
    """About thirty registered queries read the facts table alone."""
    sf = sf_dir("0.001")
    R.facts(spark, sf)
    n = 0
    for name, fn in R.QUERIES.items():
        if name in ("module_summary", "progress", "enumerator_deviation", "lcs_na_rate", "fcg_share_top_areas", "daily_counts_cumulative"):
            files = [f for f in fn(spark, sf).inputFiles()]
            assert files and all("/facts-" in f for f in files), name
            n += 1
    assert n == 6
    assert set(P.MODULE_ORDER) <= {r.module for r in R.QUERIES["module_summary"](spark, sf).collect()}


def test_rows_are_aggregated_by_hash(spark, survey, dash):
    """No aggregate sorts the rows: only the one that merges partial rows may."""
    plan = A.build(survey, dash)._jdf.queryExecution().executedPlan().toString()
    kinds = [line.split("Aggregate(")[0].split()[-1].strip("+-: ") for line in plan.splitlines() if "Aggregate(" in line]
    assert kinds[-2:] == ["Hash", "Hash"], kinds  # nearest to the rows: partial and final
