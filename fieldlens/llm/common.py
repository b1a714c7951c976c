"""Helpers shared by the training-data operators.

Nothing here is an operator: table reading, lineage cuts in the shared folder,
batch iteration and a bounded memo of encoded text pieces.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Rows and bytes in one Arrow batch sent to a Python worker: they bound the worker's
#: memory, whatever the size of a partition or of its texts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Rows of a file of an intermediate table whose number of rows is known before it is written.
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader (any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty); other columns never travel."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session (a lower bound of the session's own is kept)."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder for an intermediate table, under the cluster's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fieldlens-llm/{label}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, label: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: a lineage cut that a
    lost executor cannot undo.  The folder stays until the cluster clears it or ``drop``.

    ``rows``: about how many rows ``df`` has, if known.  A small table then is a few files of
    ``FILE_ROWS`` rows, not one of a few rows for each shuffle partition; a large one keeps its partitions."""
    path = shared_path(spark, label)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldlens_path = path
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a table made by ``cut`` that no plan needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df._fieldlens_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


class PieceMemo:
    """Encoded bytes of text pieces, kept for reuse inside one Python worker.

    ``encode`` turns a list of new pieces into their encodings.  At most ``limit``
    entries are kept: once full, further new pieces are encoded for their batch
    only, so memory is bounded and no piece is ever skipped.  A Python worker serves one
    operator after the other: the memo in use clears the one used before it.
    """

    _used = None

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int):
        self.encode, self.limit, self.known = encode, limit, {}

    def clear(self) -> None:
        self.known.clear()

    @staticmethod
    def take(memo) -> None:
        """``memo`` is the one in use now; the one used before it is cleared."""
        if PieceMemo._used is not memo:
            if PieceMemo._used is not None:
                PieceMemo._used.clear()
            PieceMemo._used = memo

    def lookup(self, pieces: Iterable[str]) -> dict:
        """A mapping that holds every one of ``pieces``."""
        PieceMemo.take(self)
        new = [p for p in pieces if p not in self.known]
        if not new:
            return self.known
        got = dict(zip(new, self.encode(new)))
        room = self.limit - len(self.known)
        if room >= len(got):
            self.known.update(got)
            return self.known
        for k in list(got)[:max(0, room)]:
            self.known[k] = got[k]
        return Either(got, self.known)


class Either(dict):
    """The batch's own encodings, then the kept ones (without copying the kept ones)."""

    def __init__(self, own: dict, kept: dict):
        super().__init__(own)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


def chunks_of(rows: Iterable, weight: Callable, most: int) -> Iterator[list]:
    """Consecutive rows in lists whose weights sum to ``most`` or little more."""
    out, total = [], 0
    for r in rows:
        out.append(r)
        total += weight(r)
        if total >= most:
            yield out
            out, total = [], 0
    if out:
        yield out
