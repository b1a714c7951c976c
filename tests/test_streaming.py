"""The streaming path yields the same flags as the batch path."""
import tempfile

from pyspark.sql import functions as F

from conftest import sf_dir
from fieldlens import profile as P
from fieldlens.plans import registry as R
from fieldlens.streaming.incremental import flag_files


def test_stream_equals_batch(spark):
    survey = R.survey(spark, sf_dir("0.001"))
    root = tempfile.mkdtemp(prefix="fieldlens-stream-test-")
    survey.write.parquet(f"{root}/in")
    q = flag_files(spark, f"{root}/in", survey.schema, f"{root}/out", "t1", P.fixture())
    q.awaitTermination(300)
    out = spark.read.parquet(f"{root}/out")
    batch = R.flagged(spark, sf_dir("0.001"))
    cols = ["row_seq", "Flag_FCS_Overall", "Flag_Timing_ShortDuration", "Flag_LCS_Narrative"]
    assert out.count() == 1000
    assert out.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert out.agg(F.countDistinct("today")).first()[0] == 30


def test_a_batch_delivered_twice_is_stored_once(spark, tmp_path):
    from fieldlens.streaming.incremental import write_batch

    sink = str(tmp_path / "sink")
    for batch_id, rows in ((0, [(1, "a"), (2, "b")]), (1, [(3, "a")]), (1, [(3, "a")]), (0, [(1, "a"), (2, "b")])):
        write_batch(spark.createDataFrame(rows, "id int, today string"), batch_id, sink)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def _same(a, b, *calls):
    for call in calls:
        x, y = call(a), call(b)
        assert x.columns == y.columns
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))


def test_tables_of_the_stream_equal_the_batch_after_every_batch(spark, tmp_path):
    from fieldlens.functions.context import resolve_context
    from fieldlens.operators import facts as A
    from fieldlens.streaming.running import RunningFacts

    f = R.flagged(spark, sf_dir("0.001"))
    dash = resolve_context(f.columns, "dashboard")
    # Days come in any order, one enumerator has a third of the rows, some keys are NULL.
    f = f.withColumns({"EnuName": F.when(F.col("row_seq") % 3 == 0, "HOT").when(F.col("row_seq") % 17 == 0, None).otherwise(F.col("EnuName")),
                       "today": F.when(F.col("row_seq") % 19 != 0, F.col("today"))})
    state = RunningFacts(str(tmp_path / "state"), dash, merge_every=2)
    part = lambda k: f.where(F.col("row_seq") % 5 == k) if k < 5 else f.limit(0)
    calls = (lambda t: A.daily_counts(t, dash, 500), lambda t: A.score_trend(t, dash), lambda t: A.progress(t, dash, 900),
             lambda t: A.enumerator_deviation(t, dash), lambda t: A.first_supervisor(t, dash))
    # Batch 2 is delivered again before the next one; batch 0 again when it is folded already; batch 5 is empty.
    for batch_id, seen in ((0, 1), (1, 2), (2, 3), (2, 3), (3, 4), (0, 4), (4, 5), (5, 5)):
        state.add(part(batch_id), batch_id)
        if batch_id in (2, 4, 5):
            _same(state.read(spark), A.build(f.where(F.col("row_seq") % 5 < seen), dash), *calls)
    assert state._folded(spark)[1] >= 1
    n = state.read(spark).agg(F.sum("n")).first()[0]
    assert state.clear(spark) > 0 and state.read(spark).agg(F.sum("n")).first()[0] == n == 1000


def test_a_flagging_stream_keeps_the_tables_up_to_date(spark, tmp_path):
    from fieldlens.functions.context import resolve_context
    from fieldlens.operators import facts as A
    from fieldlens.streaming.running import RunningFacts

    survey = R.survey(spark, sf_dir("0.001")).cache()
    f = R.flagged(spark, sf_dir("0.001"))
    dash = resolve_context(f.columns, "dashboard")
    state = RunningFacts(str(tmp_path / "state"), dash)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):  # the second run of the same stream takes up the files that came since
        survey.where(F.col("row_seq") % 2 == k).coalesce(1).write.mode("append").parquet(source)
        q = flag_files(spark, source, survey.schema, sink, "t2", P.fixture(), running=state, files_per_batch=1)
        q.awaitTermination(300)
        assert q.exception() is None
        _same(state.read(spark), A.build(f.where(F.col("row_seq") % 2 <= k), dash), lambda t: A.daily_counts(t, dash), lambda t: A.score_trend(t, dash))
    survey.unpersist()
