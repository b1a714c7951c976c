"""The unchanged row rules on a stream of new interviews.

``run_checks`` is a stateless projection, so it applies to a streaming
DataFrame as is.  New submissions land as files; ``flag_files`` picks them up
incrementally and adds their flagged rows to a Parquet table partitioned by
micro-batch and interview day.  Progress and exactly-once bookkeeping live in the query's
checkpoint folder under ``spark.checkpoint.dir``.  The monitoring tables of all interviews so
far come from ``RunningFacts``, which a stream keeps up to date batch by batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import profile as P
from ..functions.context import Context
from ..plans.engine import run_checks
from ..session import checkpoint_dir
from .running import RunningFacts


def flag_stream(stream: DataFrame, prof: P.Profile | None = None) -> DataFrame:
    """Flagged rows of a streaming survey (no state, no shuffle)."""
    return run_checks(stream, prof or P.batch())


def write_batch(batch: DataFrame, batch_id: int, sink: str, date_col: str = "today") -> None:
    """One micro-batch into a folder of its own, ``_batch=<id>``, partitioned by day.

    ``foreachBatch`` delivers a batch again when the query failed between the write and the
    commit.  The folder is overwritten then, so the sink holds every row once."""
    writer = batch.write.mode("overwrite")
    if date_col in batch.columns:
        writer = writer.partitionBy(date_col)
    writer.parquet(f"{sink.rstrip('/')}/_batch={batch_id}")


def _start(stream: DataFrame, each, tag: str, available_now: bool) -> StreamingQuery:
    """Hand every micro-batch to ``each``; progress is kept under ``tag`` in the shared folder."""
    location = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/fieldlens-stream/{tag}"
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _source(spark: SparkSession, source: str, schema: StructType, fmt: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(source)


def flag_files(spark: SparkSession, source: str, schema: StructType, sink: str, name: str,
               prof: P.Profile | None = None, fmt: str = "parquet", date_col: str = "today",
               available_now: bool = True, running: RunningFacts | None = None,
               files_per_batch: int | None = None) -> StreamingQuery:
    """Read new survey files from ``source`` and append their flagged rows to ``sink``.

    Each micro-batch is written by ``write_batch``; a restarted query resumes from its
    checkpoint, and a batch that is delivered again replaces what it wrote before.
    ``running`` also gets the aggregates of every batch, from the rows just written.
    """
    flagged = flag_stream(_source(spark, source, schema, fmt, files_per_batch), prof)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, sink, date_col)
        if running:
            spark_ = batch.sparkSession
            running.add(spark_.read.schema(batch.schema).parquet(f"{sink.rstrip('/')}/_batch={batch_id}"), batch_id)

    # One checkpoint per (name, source, sink): a restart resumes exactly this stream.
    return _start(flagged, write, f"{name}-{hashlib.sha1(f'{source}|{sink}'.encode()).hexdigest()[:10]}", available_now)


def aggregate_files(spark: SparkSession, source: str, schema: StructType, running: RunningFacts, name: str,
                    available_now: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Bring ``running`` up to date with flagged files that are only ever added to ``source``."""
    tag = f"{name}-{hashlib.sha1(f'{source}|{running.path}'.encode()).hexdigest()[:10]}"
    return _start(_source(spark, source, schema, "parquet", files_per_batch), running.add, tag, available_now)
