"""Ingest: typed table and report from one pass over the input."""
import json
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens import profile as P
from fieldlens.sources import ingest as I
from fieldlens.sources.survey import coerce_types

TEXT = "_uuid string, row_seq long, HHSize string, FCSStap string, today string, start string, EnuName string, extra string"
ROWS = [("a", 1, "4", "7", "2024-05-01", "2024-05-01 08:00:00", "E1", "x"), ("b", 2, "four", "5d", "31/31/2024", "soon", "E1", None),
        ("c", 3, " ", "", None, "01/05/2024 09:30", "", "y"), ("d", 4, None, "nan", "02/05/2024", "\t", None, "z"), ("e", 5, "1e2", "1,000", "2024-05-03", "2024-05-03T07:00:00", "E2", "")]


def test_counts_and_texts(spark, tmp_path):
    raw = spark.createDataFrame(ROWS, TEXT)
    done = I.ingest(spark, raw, str(tmp_path / "in"), date_formats=["dd/MM/yyyy HH:mm", "dd/MM/yyyy"])
    assert tuple(done.shape().first()) == (5, 8)
    seen = {r.column: (r.kind, r.n_rows, r.n_answers, r.n_unparsed) for r in done.warnings().collect()}
    assert seen["HHSize"] == ("num", 5, 2, 1) and seen["FCSStap"] == ("num", 5, 1, 3)
    assert seen["today"][2:] == (3, 1) and seen["start"][2:] == (3, 1)
    texts = sorted(map(tuple, done.unparsed("_uuid").collect()))
    assert texts == [("b", "FCSStap", "5d"), ("b", "HHSize", "four"), ("b", "start", "soon"), ("b", "today", "31/31/2024"),
                     ("d", "FCSStap", "nan"), ("e", "FCSStap", "1,000")]
    assert [json.loads(x)["column"] for x in I.warning_lines(done)] == ["FCSStap", "HHSize", "start", "today"]
    same = coerce_types(raw, date_formats=["dd/MM/yyyy HH:mm", "dd/MM/yyyy"])
    assert done.survey.drop(I.UNPARSED).exceptAll(same).count() == 0 and done.survey.columns == [*raw.columns, I.UNPARSED]


def test_typed_input_has_no_warnings(spark, tmp_path):
    raw = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c")], "HHSize double, _uuid string")
    done = I.ingest(spark, raw, str(tmp_path / "in"))
    assert {r.column: (r.n_answers, r.n_unparsed) for r in done.warnings().collect()}["HHSize"] == (1, 0)
    assert done.survey.where(F.col(I.UNPARSED).isNotNull()).count() == 0 and I.warning_lines(done) == []


def test_empty_and_undeclared(spark, tmp_path):
    raw = spark.createDataFrame(ROWS, TEXT)
    none = I.ingest(spark, raw.limit(0), str(tmp_path / "none"))
    assert tuple(none.shape().first()) == (0, 8) and none.unparsed("_uuid").count() == 0
    other = I.ingest(spark, raw.select("extra"), str(tmp_path / "other"), specs={"absent": P.ColumnSpec("absent", "num")})
    assert other.shape().first().n_rows == 5 and other.warnings().count() == 0


def test_one_pass_over_the_input(spark, tmp_path):
    """The input is read once: a counting source sees each row one time."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    raw = spark.createDataFrame(ROWS, TEXT).mapInArrow(touch, T._parse_datatype_string(TEXT))
    done = I.ingest(spark, raw, str(tmp_path / "in"))
    assert seen.value == len(ROWS)
    assert done.shape().first().n_rows == len(ROWS) and done.warnings().count() > 3 and seen.value == len(ROWS)


def test_a_file_of_one_row_group_is_worked_on_by_many_tasks(spark, tmp_path, monkeypatch):
    """Rows of one task are dealt before the wide rules; small inputs stay where they are."""
    from conftest import sf_dir
    from fieldlens.plans import registry as R
    from fieldlens.sources.survey import spread

    one = spark.range(10_000).selectExpr("id", "id % 7 AS v", "map('a', id) AS m").coalesce(1)
    dealt = spread(one, 1000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2000
    assert sorted(r.id for r in dealt.collect()) == list(range(10_000))
    assert spread(one, 5000) is one
    assert spread(one.limit(0), 1000).count() == 0
    monkeypatch.setattr(R, "spread", lambda df: spread(df, 1000))
    monkeypatch.setattr(R, "code_version", lambda: f"spread-test-{tmp_path.name}")
    assert len(R.ingested_text(spark, sf_dir("0.01")).survey.inputFiles()) == 10
    assert len(R.flagged(spark, sf_dir("0.01")).inputFiles()) == 10


def test_the_blank_pattern_is_tried_on_unread_texts_only(spark):
    """Of read answers no text is looked at twice."""
    from fieldlens.functions.columns import col

    shown = str(I._unread(col("raw"), col("read"))._jc.toString()).lower()
    assert shown.index("isnull") < shown.index("rlike")


def test_numbers_as_text(spark):
    texts = ["1", " 6 ", "-.5", "+2.", "1e3", "1E-2", "inf", "-Infinity", "INF", "5d", "2f", "nan", "NaN", "1,000", "", "0x1p3", "1e", ".", "--1", None]
    got = coerce_types(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, HHSize string")).orderBy("i").collect()
    inf = float("inf")
    assert [r.HHSize for r in got] == [1.0, 6.0, -0.5, 2.0, 1000.0, 0.01, inf, -inf, inf] + [None] * 11


def test_plain_numbers_are_read_without_a_pattern(spark):
    """Most answers need no pattern, and any text is read as the pattern reads it."""
    from fieldlens.sources import survey as S

    plain = ["1", "7.0", "2.", "1e3", "1E-2", "1e400", "0", "12345678901234567890"]
    pick = random.Random(4)
    odd = ["".join(pick.choice("0159+-.eExXpdDfFnNaAiI, \t\n\r\u0085\u00a0\u0665") for _ in range(pick.randint(0, 5))) for _ in range(4000)]
    odd += ["-.5", "+2.", "-7.0", "5\n", "5\n\n", "\t5", "5\t", "5 \n", "0x1p3", "0X1P3d", "+0x1p3", "5d", "5dd", "5f", "+NaN", "-NaN", "NaNd", "+inf", "-Infinity", "infinityd", " 5 ", "5 d"]
    rows = spark.createDataFrame([(t,) for t in plain + odd + [None]], "t string")
    by_pattern = F.when(F.trim("t").rlike(S.NUMERIC_TEXT), F.trim("t").try_cast("double"))
    seen = rows.select("t", S._plain_number(F.col("t")).alias("plain"), S._to_double(F.col("t"), T.StringType()).alias("got"), by_pattern.alias("want"))
    assert seen.where("NOT got <=> want").collect() == []
    assert seen.where("plain IS NOT NULL AND NOT plain <=> want").count() == 0
    assert {r.t for r in seen.where("plain IS NOT NULL").collect()} >= set(plain)
    assert seen.where("want IS NOT NULL").count() > 100 and seen.where("want IS NULL").count() > 100


def test_a_date_pattern_is_tried_on_texts_with_its_marks(spark):
    """A pattern whose marks a text lacks is not tried (a failed reading is an exception); results stay."""
    from fieldlens.sources import survey as S

    formats = ["dd/MM/yyyy HH:mm:ss.SSSSSS", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "yyyyMMdd", "dd-MM-yyyy['T'HH]"]
    texts = ["01/05/2024", "01/05/2024 09:30", "01/05/2024 09:30:01.000002", "2024-05-01", "20240501", "01-05-2024", "01-05-2024T07", "31/31/2024", "soon", "", " 02/05/2024 ", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", S._moment(F.col("t"), formats).cast("string").alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == ["2024-05-01 00:00:00", "2024-05-01 09:30:00", "2024-05-01 09:30:01.000002", "2024-05-01 00:00:00", "2024-05-01 00:00:00",
                                  "2024-05-01 00:00:00", "2024-05-01 07:00:00", None, None, None, "2024-05-02 00:00:00", None]
    tried = spark.range(1).select(S._with_marks(F.lit("01/05/2024"), formats[0], F.raise_error(F.lit("tried"))).cast("string").alias("m"))
    assert tried.first().m is None


def test_an_ingest_writes_moments_as_one_number(spark, tmp_path, monkeypatch):
    from conftest import sf_dir
    from fieldlens.plans import registry as R

    monkeypatch.setattr(R, "code_version", lambda: f"moments-test-{tmp_path.name}")
    file = R.ingested_text(spark, sf_dir("0.001")).survey.inputFiles()[0].removeprefix("file://")
    schema = pq.ParquetFile(file).schema
    kinds = {schema.column(i).path: schema.column(i).physical_type for i in range(len(schema))}
    assert kinds["start"] == kinds["end"] == "INT64"


def test_rows_of_a_flagging_task_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """``master_narratives`` reads a flagged table whose tasks, a file each, hold as many rows at ten times the events."""
    from conftest import sf_dir
    from fieldlens.plans import registry as R
    from fieldlens.sources.survey import spread

    monkeypatch.setattr(R, "spread", lambda df: spread(df, 400))
    monkeypatch.setattr(R, "code_version", lambda: f"narratives-test-{tmp_path.name}")
    for sf, rows in (("0.001", 1_000), ("0.01", 10_000)):
        most = R.flagged(spark, sf_dir(sf)).groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
        assert most[1] == rows and most[0] < 800
        assert R.QUERIES["master_narratives"](spark, sf_dir(sf)).count() > rows / 4
