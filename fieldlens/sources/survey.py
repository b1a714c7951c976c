"""Survey ingest (A1-A4) and typed coercion.

CSV is read with every column as text and coerced once by the declared spec;
Parquet / ORC / JSON keep their types and only get NaN turned into NULL.
Nothing here runs a job except ``shape`` and ``spread``.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P

SUPPORTED_FORMATS = ("csv", "parquet", "orc", "json")

# A decimal number with optional sign and exponent, or an infinity.  Text such
# as '5d', 'nan', '1,000' or '' is not a number (it becomes NULL).
NUMERIC_TEXT = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)$"


def declared_specs(profile: P.Profile | None = None) -> dict[str, P.ColumnSpec]:
    """Every column the modules know, by name, with its declared kind; a profile adds its own."""
    specs: dict[str, P.ColumnSpec] = {}
    for group in (P.DEMO_SPECS, P.FCS_SPECS, P.RCSI_SPECS, P.HDDS_SPECS, P.HOUSING_SPECS, P.LCS_SPECS, P.TIMING_SPECS):
        for s in group:
            specs.setdefault(s.name, s)
    own = profile or P.batch()
    for cols in (*P.EXP_COLUMNS.values(), *own.expenses.values(), own.fcs_weights, own.rcsi_weights, *own.lcs_tiers.values()):
        for c in cols:
            specs.setdefault(c, P.ColumnSpec(c, "num", required=False))
    for c in P.HHS_COLUMNS:
        specs.setdefault(c, P.ColumnSpec(c, "num", required=False))
    return specs


def _plain_number(c: Column) -> Column:
    """The number of a text as most are written, NULL if ``NUMERIC_TEXT`` has to look at it.

    The text starts with a digit, and with one more ``d`` (which a cast allows once, at the end)
    it is still a number: so nothing but the number stands in it.  It isn't hexadecimal; a comma
    or a blank at the end would only make the cast fail, which is slow."""
    apart = c.startswith("0x") | c.startswith("0X") | c.endswith(" ") | F.contains(c, F.lit(","))
    return F.when((c >= F.lit("0")) & (c < F.lit(":")) & ~apart, F.concat(c, F.lit("d")).try_cast("double"))


def _to_double(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        text = F.trim(c)
        return F.coalesce(_plain_number(c), F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double")))  # neither is a NaN
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        parsed = c.cast("double")
    else:
        parsed = F.lit(None).cast("double")
    return F.when(~F.isnan(parsed), parsed)  # NaN -> NULL; NULL stays NULL


def _moment(c: Column, formats: Sequence[str]) -> Column:
    """Text as a timestamp: ISO first, then the given patterns in order; anything else is NULL."""
    text = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_timestamp(text), *[_with_marks(text, f, F.try_to_timestamp(text, F.lit(f))) for f in formats])


def _with_marks(text: Column, pattern: str, read: Column) -> Column:
    """``read`` for texts that hold every mark (``/ : - .`` or blank) of the pattern; a text without
    one can't be read by it, and a reading that fails costs far more than this look."""
    if any(x in pattern for x in "'[]"):  # quoted or optional parts
        return read
    marks = sorted({x for x in pattern if x in "/:-. "})
    return F.when(reduce(lambda a, b: a & b, [F.contains(text, F.lit(x)) for x in marks]), read) if marks else read


def _to_timestamp(c: Column, dtype: T.DataType, formats: Sequence[str]) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp")
    return _moment(c, formats)


def _to_date(c: Column, dtype: T.DataType, formats: Sequence[str]) -> Column:
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return F.to_date(_moment(c, formats))


def coerce_types(df: DataFrame, specs: dict[str, P.ColumnSpec] | None = None, date_formats: Sequence[str] = (),
                 profile: P.Profile | None = None) -> DataFrame:
    """Cast each declared column that exists to its kind; bad values -> NULL.

    ``date_formats``: patterns of text dates (such as ``dd/MM/yyyy HH:mm``), tried after ISO."""
    specs = specs or declared_specs(profile)
    fields = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for name, spec in specs.items():
        if name not in fields:
            continue
        c, dtype = F.col(f"`{name}`"), fields[name]
        if spec.kind == "num":
            if isinstance(dtype, T.DoubleType) or isinstance(dtype, T.FloatType):
                out[name] = F.when(~F.isnan(c), c.cast("double"))
            else:
                out[name] = _to_double(c, dtype)
        elif spec.kind == "datetime":
            out[name] = _to_timestamp(c, dtype, date_formats)
        elif spec.kind == "date":
            out[name] = _to_date(c, dtype, date_formats)
        elif spec.kind == "str":
            out[name] = c.cast("string")
    return df.withColumns(out) if out else df


def load_survey(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None,
                date_formats: Sequence[str] = (), profile: P.Profile | None = None) -> DataFrame:
    """A1/A2: read a survey file set; CSV columns arrive as text (no inference)."""
    fmt = fmt.lower()
    if fmt not in SUPPORTED_FORMATS:
        raise ValueError(f"unsupported survey format {fmt!r}; supported: {SUPPORTED_FORMATS}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return coerce_types(reader.load(path), date_formats=date_formats, profile=profile)


#: Rows that a task of the wide row rules gets.
TASK_ROWS = 50_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in tasks of about ``task_rows`` rows, if some task has more than twice as many.

    A file of one row group is read by one task, whatever its rows; the rules cost much more a
    row than its move.  The rows of each task are counted first (that reads file footers only).
    Rows are dealt by a hash of all of their values, so a task that runs again deals them alike."""
    sizes = df.select().groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if (sizes.most or 0) <= 2 * task_rows:
        return df
    return df.repartition(-(-sizes.rows // task_rows), *[F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)])


def _holds_map(t: T.DataType) -> bool:
    return "map<" in t.simpleString() or "variant" in t.simpleString()


def with_row_seq(df: DataFrame, key: str | None = None) -> DataFrame:
    """Stable row order for 'first' / 'last' rules.

    Prefer a natural unique key.  Otherwise rows are numbered by file path, block offset
    within the file and position within the block, whatever tasks read them.
    """
    if "row_seq" in df.columns:
        return df
    if key is not None:
        return df.withColumn("row_seq", F.col(f"`{key}`"))
    if not df.inputFiles():  # not read from files: the order of the partitions
        return df.withColumn("row_seq", F.monotonically_increasing_id())
    # Inside a scan task rows come in file order; the id within the task keeps that order.
    spot = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return _numbered(df, spot)


def _numbered(df: DataFrame, spot: Column) -> DataFrame:
    """row_seq from (file, block, position): blocks get their place by one small aggregate."""
    placed = df.withColumn("_spot", spot)
    first = placed.groupBy(F.col("_spot.file_path").alias("_f"), F.col("_spot.file_block_start").alias("_b")).agg(
        F.count(F.lit(1)).alias("_k"), F.min("_spot.col3").alias("_m"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = first.select("_f", "_b", "_m", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_s"))
    return placed.join(starts, (F.col("_spot.file_path") == F.col("_f")) & (F.col("_spot.file_block_start") == F.col("_b"))) \
        .withColumn("row_seq", F.col("_s") + F.col("_spot.col3") - F.col("_m")).drop("_spot", "_f", "_b", "_m", "_s")


def shape(df: DataFrame) -> DataFrame:
    """A3: one-row table with the row and column counts (lazy)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def preview(df: DataFrame, n: int = 5, order: str = "row_seq") -> DataFrame:
    """A4: first ``n`` rows in stored order (a top-k, not a full sort)."""
    return df.orderBy(F.col(order)).limit(n) if order in df.columns else df.limit(n)
