"""Sources (A1-A4) and sinks."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from fieldlens import load_survey, profile as P, run_checks
from fieldlens.operators import deliver as D
from fieldlens.plans import registry as R
from fieldlens.sources.survey import preview, shape


def test_csv_round_trip_matches_parquet(spark):
    """A survey written as CSV text and loaded back gives the same flags as the typed table."""
    s = R.survey(spark, sf_dir("0.001"))
    root = tempfile.mkdtemp(prefix="fieldlens-csv-")
    s.write.option("header", True).csv(f"{root}/csv")
    back = load_survey(spark, f"{root}/csv", fmt="csv")
    assert dict(back.dtypes)["FCSStap"] == "double" and dict(back.dtypes)["start"] == "timestamp"
    back = back.withColumn("row_seq", F.col("row_seq").cast("bigint")).withColumn("_uuid", F.col("_uuid").cast("bigint"))
    cols = ["row_seq", "Flag_FCS_Overall", "Flag_Demo_Overall", "Flag_Timing_Overall", "Flag_HHExpF_Narrative"]
    a = run_checks(back, P.fixture()).select(cols)
    b = R.flagged(spark, sf_dir("0.001")).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_unsupported_format(spark):
    with pytest.raises(ValueError):
        load_survey(spark, "/nowhere", fmt="xlsx")


def test_shape_and_preview(spark):
    s = R.survey(spark, sf_dir("0.001"))
    r = shape(s).first()
    assert r.n_rows == 1000 and r.n_columns == len(s.columns)
    assert [x.row_seq for x in preview(s).collect()] == [0, 1, 2, 3, 4]


def test_sinks(spark):
    f = R.flagged(spark, sf_dir("0.001"))
    ctx = R._report(f)
    root = tempfile.mkdtemp(prefix="fieldlens-out-")
    D.write_deliverables(f, ctx, f"{root}/deliv", P.fixture())
    D.write_enumerator_feedback(f, R._dash(f), f"{root}/feedback")
    logs = spark.read.parquet(f"{root}/deliv/error_logs/module=FCS")
    assert logs.count() == f.where("Flag_FCS_Overall = 1").count()
    assert spark.read.parquet(f"{root}/deliv/summary").count() == 10
    enus = sorted(d for d in os.listdir(f"{root}/feedback/rows") if d.startswith("EnuName="))
    assert len(enus) == 12
    fb = spark.read.parquet(f"{root}/feedback/rows")
    assert fb.count() == f.where(F.col("EnuName").isNotNull()).where(
        " OR ".join(f"Flag_{m}_Overall = 1" for m in P.MODULE_ORDER)).count()


def test_command_line(spark, capsys):
    from fieldlens.__main__ import main
    s = R.survey(spark, sf_dir("0.001"))
    root = tempfile.mkdtemp(prefix="fieldlens-cli-")
    s.write.parquet(f"{root}/in")
    assert main(["--input", f"{root}/in", "--output", f"{root}/out", "--format", "parquet", "--skip", "LCS"]) == 0
    printed = capsys.readouterr().out
    assert "FCS" in printed and "LCS" not in printed
    assert spark.read.parquet(f"{root}/out/summary").count() == 9
    assert spark.read.parquet(f"{root}/out/error_logs/module=Timing").count() > 0
