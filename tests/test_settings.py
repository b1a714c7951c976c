"""Profiles from settings, text dates, row order over files, fresh tables, safe divisions."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldlens import __main__ as cli
from fieldlens import profile as P
from fieldlens.functions.context import Context
from fieldlens.functions.rules import text
from fieldlens.operators import deliver as D
from fieldlens.operators import monitor as M
from fieldlens.operators.checks import Check, ModulePlan
from fieldlens.plans.engine import modules_in, run_checks
from fieldlens.plans.materialize import drop_versions, input_fingerprint, materialize
from fieldlens.sources.survey import coerce_types, load_survey, with_row_seq


def test_settings_layers():
    prof = P.batch().with_settings({"fcs_weights": {"FCSStap": 1}, "ranges": {"HHSize": [1, 20]}, "thresholds": {"FCS": {"low_fcs_threshold": 5}}})
    assert prof.fcs_weights == {"FCSStap": 1.0} and prof.t("FCS", "low_fcs_threshold") == 5 and prof.t("FCS", "high_fcs_threshold") == 112
    assert prof.with_overrides(P.parse_setting("Timing.short_duration_min=15")).t("Timing", "short_duration_min") == 15
    for wrong in ({"weight": {}}, {"expenses": {"HHExpX": []}}, {"thresholds": {"FCS": {"nothing": 1}}}):
        with pytest.raises(KeyError):
            P.batch().with_settings(wrong)
    with pytest.raises(ValueError):
        P.parse_setting("short_duration_min")


def test_fingerprint_tells_values_apart():
    a, b = (P.batch().with_overrides({"FCS": {"low_fcs_threshold": v}}) for v in (5, 6))
    assert a.name == b.name and a.fingerprint() != b.fingerprint() == P.batch().with_overrides({"FCS": {"low_fcs_threshold": 6}}).fingerprint()


def test_settings_reach_the_checks(spark):
    rows = spark.createDataFrame([(0, 25.0, 7.0)], "row_seq int, HHSize double, FCSStap double")
    prof = P.batch().with_settings({"fcs_weights": {"FCSStap": 3}, "ranges": {"HHSize": [1, 20]}})
    got = run_checks(rows, prof).first()
    assert got.FCS == 21.0 and got.Flag_Demo_Erroneous == 1 and got.Flag_Any_Overall == 1


def _water(avail, prof):
    return ModulePlan("Water", {}, "CAST(`Litres` IS NULL AS INT)", text("no answer"), "0", "''",
                      [Check("Little", "`Litres` < 15", text("little water"))])


def test_own_module(spark):
    prof = P.batch().with_module("Water", _water).select(only=["Water"])
    f = run_checks(spark.createDataFrame([(0, 10.0), (1, None), (2, 20.0)], "row_seq int, Litres double"), prof)
    assert modules_in(f) == ["Water"]
    assert [(r.Flag_Water_Overall, r.Flag_Water_Narrative) for r in f.orderBy("row_seq").collect()] == \
        [(1, "little water"), (1, "no answer"), (0, "No issues found")]
    assert {r.check: r.n_flagged for r in M.check_counts(f).collect()}["Little"] == 1


def test_text_dates(spark):
    df = spark.createDataFrame([("05/01/2024 10:00", "05/01/2024"), ("2024-01-06 08:00:00", "2024-01-06"), ("soon", "never")], "start string, today string")
    got = coerce_types(df, date_formats=["dd/MM/yyyy HH:mm", "dd/MM/yyyy"]).collect()
    assert [r.start and r.start.day for r in got] == [5, 6, None]
    assert [r.today for r in got] == [dt.date(2024, 1, 5), dt.date(2024, 1, 6), None]


def test_row_order_over_files(spark, tmp_path):
    for k in range(6):
        spark.range(k * 50, k * 50 + 50).select(F.col("id").alias("HHSize")).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    got = with_row_seq(load_survey(spark, f"{tmp_path}/in")).orderBy("row_seq").collect()
    assert [r.row_seq for r in got] == list(range(300)) and [int(r.HHSize) for r in got] == list(range(300))


def test_changed_input_is_read_again(spark, tmp_path):
    path, name = f"file://{tmp_path}/in", f"fresh-{tmp_path.name}"

    def count(n):
        spark.range(n).write.mode("overwrite").parquet(path)
        return materialize(spark, lambda: spark.read.parquet(path), f"{name}-{input_fingerprint(spark, [path])}").count()

    assert [count(10), count(1000)] == [10, 1000]


def test_versions(spark, tmp_path):
    name = f"versions-{tmp_path.name}"
    old = materialize(spark, lambda: spark.range(3), name)
    new = materialize(spark, lambda: spark.range(5), name, rebuild=True)
    assert (old.count(), new.count(), materialize(spark, lambda: spark.range(9), name).count()) == (3, 5, 5)
    assert len(drop_versions(spark, name)) == 1 and new.count() == 5


def _survey(spark, rows):
    return run_checks(spark.createDataFrame(rows, "row_seq int, HHID string, _uuid string, EnuName string, ADMIN1Name string, today string, FCSStap double"),
                      P.batch().select(only=["FCS"]))


def test_divisions_and_text_dates_do_not_throw(spark):
    f = _survey(spark, [(0, "a", "x", "E1", "A1", "2024-01-01 23:00:00", 0.0), (1, "a", "y", "E2", "A1", "2024-01-02 01:00:00", 7.0),
                        (2, "b", "z", None, None, "bad day", 7.0)])
    f = f.withColumn("today", F.col("today").cast("string"))
    dash, rep = Context("HHID", "EnuName", None, "ADMIN1Name", "today"), Context("_uuid", "EnuName", None, "ADMIN1Name", "today")
    f = f.drop("today").join(spark.createDataFrame([(0, "2024-01-01 23:00:00"), (1, "2024-01-02 01:00:00"), (2, "bad day")], "row_seq int, today string"), "row_seq")
    f = f.withColumns({"rCSI": F.lit(1.0), "HDDS": F.lit(1.0)})
    head = M.survey_header(f, rep).first()
    assert (head.n, head.days_active) == (3, 1)  # two hours, although two calendar days
    assert [r.n for r in M.daily_counts(f, rep).orderBy("date").collect()] == [1, 1]
    assert M.submission_matrix(f, rep).count() == 2 and M.score_trend(f, rep).count() == 2
    assert D.progress(f, rep, 0).first().pct_done is None
    assert {r.pct_done for r in D.enumerator_completion(f, rep, 0).collect()} == {None}
    alerts = {(r.rule, r.entity): r.value for r in D.priority_alerts(f, dash, rep).collect()}
    assert alerts[("duplicate_ids", None)] == 1.0 and alerts[("overall_flag_rate", None)] == 33.3
    assert alerts[("enumerator_flag_rate", "E1")] == 100.0


def test_empty_survey(spark):
    f = _survey(spark, [(0, "a", "x", "E1", "A1", "2024-01-01", 7.0)]).where("row_seq > 5")
    rep = Context("_uuid", "EnuName", None, "ADMIN1Name", "today")
    assert [r.code for r in D.recommendations(f, rep).collect()] == ["quality_acceptable"]
    assert D.priority_alerts(f, rep, rep).count() == 0


def test_tables_are_complete(spark):
    rows = [(i, f"h{i}", f"u{i}", f"E{i % 40}", "A1", "2024-01-01", 0.0) for i in range(400)]
    f = _survey(spark, rows).withColumn("FCS", F.when(F.col("row_seq") == 0, 500.0).when(F.col("row_seq") == 1, -9.0).otherwise(F.col("FCS")))
    f = f.withColumn("rCSI", F.lit(0.0))
    rep = Context("_uuid", "EnuName", None, "ADMIN1Name", "today")
    assert D.priority_alerts(f, rep, rep).where("rule = 'enumerator_flag_rate'").count() == 40
    assert D.recommendations(f, rep).where("code = 'enumerators_above_30'").count() == 40
    assert {r.bin for r in M.score_hist(f).where("metric = 'FCS'").collect()} == {0, 178, -4}
    f = f.withColumns({c: F.col("row_seq").cast("double") for c in P.EXP_COLUMNS["HHExpF"]})
    assert M.expenditure_extremes(f).select("item").distinct().count() == 42


def test_catalogue_names_every_check(spark):
    known = {(r.module, r.check): (r.description, r.action) for r in D.catalogue(spark).collect()}
    assert all(d and a for d, a in known.values()) and D.SEVERITY.keys() <= known.keys()
    assert len({a for (m, _), (d, a) in known.items() if m == "FCS"}) > 5


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text("_uuid,HHSize,FCSStap,start,end\n1,25,7,05/01/2024 10:00,05/01/2024 10:12\n2,3,7,05/01/2024 10:00,05/01/2024 11:00\n")
    (tmp_path / "s.json").write_text(json.dumps({"ranges": {"HHSize": [1, 20]}}))
    assert cli.main(["-i", f"{tmp_path}/in.csv", "-o", f"{tmp_path}/out", "--settings", f"{tmp_path}/s.json", "--set", "Timing.short_duration_min=15",
                     "--dates", "dd/MM/yyyy HH:mm", "--only", "Demo,Timing"]) == 0
    f = spark.read.parquet(f"{tmp_path}/out/flagged").orderBy("_uuid").collect()
    assert [(r.Flag_Demo_Erroneous, r.Flag_Timing_ShortDuration) for r in f] == [(1, 1), (0, 0)]
    assert "Timing: 1 of 2" in capsys.readouterr().out
