"""One id holding a third of all rows: id-level operators stay correct (vs DuckDB)."""
import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from fieldlens import profile as P
from fieldlens.functions.context import resolve_context
from fieldlens.operators import deliver as D
from fieldlens.operators import monitor as M
from fieldlens.plans import oracle as O
from fieldlens.plans import registry as R
from fieldlens.sources import fixture as FX

NORMAL = "CASE WHEN event_id % 50 = 1 THEN event_id-1 ELSE event_id END"
HOT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END"
SF = "0.01"


@pytest.fixture(scope="module")
def hot(spark):
    events = spark.read.parquet(FX.events_path(sf_dir(SF)))
    keyed = events.selectExpr("*", f"{FX.PLANT_KEY} AS k")
    cols = [(n, HOT if n == "_uuid" else e) for n, e in FX.SURVEY_COLUMNS]
    survey = keyed.selectExpr(*[f"{e} AS `{n}`" for n, e in cols])
    # Several files: AQE splits a hot partition between the map tasks that wrote it.
    return R.flagged_from(spark, survey.repartition(8), "hot-id")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir(SF)}/events.parquet')")
    return c


def _sql(body_key: str) -> str:
    return O.ORACLE_SQL[body_key].replace(NORMAL, HOT)


def test_hot_id_rates_and_master(spark, con, hot):
    f = hot
    rep, dash = resolve_context(f.columns, "report"), resolve_context(f.columns, "dashboard")
    got = sorted((r.enumerator, r.surveys, r.flagged) for r in M.flag_rate_by_enumerator(f, rep).collect())
    exp = sorted((r[0], r[1], r[2]) for r in con.execute(_sql("flag_rate_by_enumerator")).fetchall())
    assert got == exp
    n_dup = M.duplicate_ids(f, dash).where(F.col("id") == 0).first().n_rows
    assert n_dup == con.execute(f"WITH s AS ({FX.survey_sql()}) SELECT count(*) FROM s WHERE _uuid = 0".replace(
        NORMAL, HOT)).fetchone()[0]
    ms = D.master_sheet(f, rep).where(F.col("_uuid") == 0)
    exp_ms = con.execute(_sql("master_sheet") + "").df()
    exp_ms = exp_ms[exp_ms["_uuid"] == 0]
    assert ms.count() == len(exp_ms)
    last = ms.select(*[f"{m}_Issues" for m in O.MODULES]).distinct().collect()
    assert len(last) == 1  # every row of the hot id carries the same last-row texts
    assert list(last[0]) == list(exp_ms[[f"{m}_Issues" for m in O.MODULES]].drop_duplicates().iloc[0])
    # each row keeps its own text, nothing is collected per id
    assert sorted(r.Flag_All_Narrative for r in ms.collect()) == sorted(exp_ms["Flag_All_Narrative"])


HOT_ENU = "CASE WHEN event_id % 3 = 0 THEN 'ENU_HOT' ELSE concat('ENU_', CAST(user_id % 12 AS VARCHAR(4))) END"


def test_hot_enumerator_feedback_sink_keeps_all_rows(spark, tmp_path):
    """One enumerator with a third of the rows: every flagged row is written, and
    the hot enumerator's folder is written by several tasks, not one."""
    events = spark.read.parquet(FX.events_path(sf_dir(SF)))
    keyed = events.selectExpr("*", f"{FX.PLANT_KEY} AS k")
    cols = [(n, HOT_ENU if n == "EnuName" else e) for n, e in FX.SURVEY_COLUMNS]
    f = R.flagged_from(spark, keyed.selectExpr(*[f"{e} AS `{n}`" for n, e in cols]), "hot-enumerator")
    rep = resolve_context(f.columns, "report")
    expected = f.where(F.col("EnuName").isNotNull() & (M.any_flag(f) == 1)).count()
    hot_expected = f.where((F.col("EnuName") == "ENU_HOT") & (M.any_flag(f) == 1)).count()
    assert len(f.inputFiles()) == 1  # the spread must not come from the input's files
    D.write_enumerator_feedback(f, rep, str(tmp_path / "fb"), rows_per_file=200)
    rows = spark.read.parquet(str(tmp_path / "fb" / "rows"))
    assert rows.count() == expected
    assert rows.where(F.col("EnuName") == "ENU_HOT").count() == hot_expected > 200
    files = [p for p in (tmp_path / "fb" / "rows" / "EnuName=ENU_HOT").iterdir() if p.suffix == ".parquet"]
    assert len(files) >= -(-hot_expected // 200)
    assert all(pq.read_metadata(p).num_rows <= 200 for p in files)


def test_spread_follows_the_rows_of_a_key(spark):
    """As many tasks a key as its rows fill files; small keys keep one."""
    df = spark.range(9000).select(F.when(F.col("id") < 8000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("row_seq"))
    from fieldlens.plans.materialize import session_conf

    with session_conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):  # these are a few kilobytes
        with_task = D.spread_by_key(df.coalesce(1), "k", 1000).withColumn("t", F.spark_partition_id())
        tasks = {r.k: r.n for r in with_task.groupBy("k").agg(F.countDistinct("t").alias("n")).collect()}
    assert tasks.pop("hot") > 2 and set(tasks.values()) == {1} and len(tasks) == 50


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    rows = df._jdf.queryExecution()
    df.collect()
    return rows.executedPlan().toString()


SPLIT = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.mark.parametrize("name", ["duplicate_rows", "master_sheet", "box_outliers"])
def test_hot_keys_are_split(spark, hot, name, monkeypatch):
    """The final plan of the joins by id or group splits the hot key's partition."""
    from fieldlens.plans.materialize import session_conf

    monkeypatch.setattr(M, "BROADCAST_GROUPS", 0)  # as if the groups were too many to send to every task
    dash, rep = resolve_context(hot.columns, "dashboard"), resolve_context(hot.columns, "report")
    skewed = hot.withColumn("EnuName", F.when(F.col("row_seq") % 2 == 0, F.lit("HOT")).otherwise(F.col("row_seq").cast("string")))
    with session_conf(spark, SPLIT):
        df = {"duplicate_rows": lambda: M.duplicate_rows(hot, dash), "master_sheet": lambda: D.master_sheet(hot, rep),
              "box_outliers": lambda: M.box_outliers(skewed, "EnuName", "Timing_Duration_Min", "_uuid")}[name]()
        assert "skew=true" in _final_plan(df)


def test_few_groups_move_no_rows(spark, hot):
    """With few groups the fences go to the rows: no exchange carries a row."""
    plan = _final_plan(M.box_outliers(hot, "EnuName", "Timing_Duration_Min", "_uuid"))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]


def test_a_sink_task_holds_a_bounded_part(spark, monkeypatch):
    """However large the files may be, a writer task sorts few rows; small keys share a task."""
    monkeypatch.setattr(D, "ROWS_PER_TASK", 500)
    df = spark.range(9000).select(F.when(F.col("id") < 8000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("row_seq"))
    out = D.spread_by_key(df.coalesce(1), "k")
    by = out.groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("k")).collect()
    assert out.count() == 9000 and out.columns == ["k", "row_seq"]
    assert max(r.n for r in by) <= 1000 and 16 <= len(by) <= 18 and max(r.k for r in by) >= 20
    assert D.spread_by_key(df.limit(0), "k").count() == 0
