"""Ingest with a report (A1, A3, B3): the survey is coerced and written in one pass, and what
that pass saw is kept beside it.

While the typed table is written, observed metrics count its rows and, for every declared
column, the answers and the texts that could not be read (they become NULL).  So neither the
shape of the survey nor the coercion warnings cost a second scan.  The texts themselves stay
on their rows, in the map column ``_unparsed`` (column -> text), for whoever follows them up.

A blank text is a missing answer, not an unreadable one.  Metrics come from the tasks that
wrote the table, each counted once, also when a lost executor's tasks ran again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import profile as P
from ..functions.columns import any_of, col, safe
from .survey import coerce_types, declared_specs

UNPARSED = "_unparsed"
REPORT = "column string, kind string, n_rows long, n_answers long, n_unparsed long, n_columns long"


@dataclass(frozen=True)
class Ingested:
    """A typed survey and the report of its ingest, both read from their files."""

    survey: DataFrame
    report: DataFrame

    def shape(self) -> DataFrame:
        """A3: rows and columns, as counted while the survey was written."""
        return self.report.where("column IS NULL").select("n_rows", "n_columns")

    def warnings(self) -> DataFrame:
        """For every declared column its answers and unreadable texts."""
        return self.report.where("column IS NOT NULL").drop("n_columns")

    def unparsed(self, *keys: str) -> DataFrame:
        """The unreadable texts with the ``keys`` of their rows: a row for each."""
        return self.survey.where(col(UNPARSED).isNotNull()).select(*[col(k) for k in keys], F.explode(UNPARSED).alias("column", "text"))


def _unread(raw: Column, read: Column) -> Column:
    """Whether a text says something that its column's kind can't hold."""
    # In this order: the pattern is only tried on texts that were not read.
    return raw.isNotNull() & read.isNull() & raw.rlike(r"\S")


def ingest(spark: SparkSession, raw: DataFrame, path: str, specs: dict[str, P.ColumnSpec] | None = None,
           date_formats: Sequence[str] = (), profile: P.Profile | None = None) -> Ingested:
    """Coerce ``raw`` by its declared columns, write it to ``path`` and report on it.

    One job reads ``raw`` once.  Columns without a declaration stay as they are."""
    specs = {n: s for n, s in (specs or declared_specs(profile)).items() if n in raw.columns}
    texts = [f.name for f in raw.schema.fields if f.name in specs and isinstance(f.dataType, T.StringType) and specs[f.name].kind != "str"]
    # Raw texts travel beside the typed columns, so that both sides of a reading are at hand.
    kept = raw.withColumns({f"_raw_{i}": col(c) for i, c in enumerate(texts)}) if texts else raw
    typed = coerce_types(kept, specs, date_formats)
    unread = [_unread(F.col(f"_raw_{i}"), col(c)) for i, c in enumerate(texts)]
    pairs = [F.when(u, F.struct(F.lit(c).alias("key"), F.col(f"_raw_{i}").alias("value"))) for i, (c, u) in enumerate(zip(texts, unread))]
    # Most rows have no unreadable text: they build no map.
    found = F.when(any_of(unread), F.map_from_entries(F.array_compact(F.array(*pairs)))) if pairs else F.lit(None).cast("map<string,string>")
    out = typed.withColumn(UNPARSED, found)
    watch = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")] + [F.count(col(c)).alias(f"a{i}") for i, c in enumerate(specs)] + [
        F.count_if(safe(u)).alias(f"u{i}") for i, u in enumerate(unread)]
    out.observe(watch, *metrics).drop(*[f"_raw_{i}" for i in range(len(texts))]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/survey")
    seen = watch.get
    lines = [(c, s.kind, seen["rows"], seen[f"a{i}"], seen[f"u{texts.index(c)}"] if c in texts else 0, None) for i, (c, s) in enumerate(specs.items())]
    lines.append((None, None, seen["rows"], None, None, len(raw.columns)))
    spark.createDataFrame(lines, REPORT).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/report")  # a line a column
    return ingested(spark, path)


def ingested(spark: SparkSession, path: str) -> Ingested:
    """An earlier ingest, read from its files."""
    root = path.rstrip("/")
    return Ingested(spark.read.parquet(f"{root}/survey"), spark.read.schema(REPORT).parquet(f"{root}/report"))


def warning_lines(done: Ingested) -> list[str]:
    """The columns with unreadable texts as log lines (one a declared column at most)."""
    rows = done.warnings().where("n_unparsed > 0").orderBy(F.desc("n_unparsed"), "column").collect()
    return [json.dumps({"column": r.column, "kind": r.kind, "unparsed": r.n_unparsed, "rows": r.n_rows}) for r in rows]
