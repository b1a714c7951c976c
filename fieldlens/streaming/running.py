"""The monitoring tables of a stream of interviews: state kept by batch and merged.

The state is the partial-aggregate table of ``operators.facts``: counts and exact sums by
enumerator, area and day.  A micro-batch adds the table of its own rows in a folder named by
its id, so a batch that is delivered again replaces what it added before and nothing counts
twice.  Interviews may come late or for any day: no watermark drops them, as the state has a
row for each enumerator, area and day and not for each interview.

``merge`` folds the batches before the newest into one table, published by replacing a small
pointer file that names the table and the last batch in it; a reader takes that table and the
batches after it.  Sums are decimals, so the result is the same to the bit however rows were
cut into batches, and equals the table built from all rows at once.

    state
      batches/_batch=17   aggregates of one batch
      v-...               aggregates of all batches up to the one that CURRENT names
      CURRENT             "v-... 16"

Defined cases: no batch yet gives no table (``read`` raises ValueError); an empty batch adds no
row; a batch that the merged table already holds is not added again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.context import Context
from ..operators import facts as A
from ..plans.materialize import _fs, _point, _pointed, exists

#: Batches that are read beside the merged table before they are folded into it.
MERGE_EVERY = 50


class RunningFacts:
    """The aggregate table of all batches added so far, in the folder ``path`` of a shared store."""

    def __init__(self, path: str, *contexts: Context, merge_every: int = MERGE_EVERY):
        self.path, self.contexts, self.merge_every = path.rstrip("/"), contexts, merge_every

    def _folded(self, spark: SparkSession) -> tuple[str | None, int]:
        """The merged table and the last batch in it."""
        named = _pointed(spark, self.path)
        if named is None:
            return None, -1
        version, last = named.split()
        return f"{self.path}/{version}", int(last)

    def _batches(self, spark: SparkSession) -> dict[int, str]:
        """The finished batches, by id.  One that is being written again has no mark and is left out."""
        fs, folder = _fs(spark, f"{self.path}/batches")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        paths = {int(n.removeprefix("_batch=")): f"{self.path}/batches/{n}" for n in names if n.startswith("_batch=")}
        return {k: p for k, p in sorted(paths.items()) if exists(spark, f"{p}/_SUCCESS")}

    def add(self, flagged: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch, or replace what the same batch added before."""
        spark = flagged.sparkSession
        _, last = self._folded(spark)
        if batch_id <= last:
            return
        A.build(flagged, *self.contexts).write.mode("overwrite").parquet(f"{self.path}/batches/_batch={batch_id}")
        if len([k for k in self._batches(spark) if k > last]) > self.merge_every:
            # Batches before this one are committed: only this one may be delivered again.
            self.merge(spark, batch_id - 1)

    def _table(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        folded, last = self._folded(spark)
        new = [p for k, p in self._batches(spark).items() if k > last and (upto is None or k <= upto)]
        if folded is None and not new:
            raise ValueError(f"no batch in {self.path}")
        parts = [spark.read.parquet(folded)] if folded else []
        # All batches have one schema; a list of paths is one scan, whatever their number.
        return A.merge(*parts, *([spark.read.schema(spark.read.parquet(new[0]).schema).parquet(*new)] if new else []))

    def read(self, spark: SparkSession) -> DataFrame:
        """The table of all rows so far, for the functions of ``operators.facts``."""
        return self._table(spark)

    def merge(self, spark: SparkSession, upto: int) -> None:
        """Fold the batches up to ``upto`` (all committed) into one table and publish it."""
        version = f"v-{uuid.uuid4().hex}"
        self._table(spark, upto).write.parquet(f"{self.path}/{version}")
        _point(spark, self.path, f"{version} {upto}")

    def clear(self, spark: SparkSession) -> int:
        """Delete folded batches and earlier merged tables (readers of them must be done)."""
        folded, last = self._folded(spark)
        fs, folder = _fs(spark, self.path)
        gone = [p for k, p in self._batches(spark).items() if k <= last]
        gone += [f"{self.path}/{f.getPath().getName()}" for f in (fs.listStatus(folder) if fs.exists(folder) else [])
                 if f.getPath().getName().startswith("v-") and f"{self.path}/{f.getPath().getName()}" != folded]
        for p in gone:
            fs.delete(_fs(spark, p)[1], True)
        return len(gone)
