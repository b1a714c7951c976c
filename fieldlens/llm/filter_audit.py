"""Operator 12: what a chain of document filters removes, in every order.

Five filters look at a whole text:

* A fails a text of fewer than 200 words, B one whose distinct words are under half of its
  words, C one with more than 2 capitals ``A-Z`` to 100 code points, D one that holds any of
  ``#$%&*|``, E one that is identical to the text of a smaller ``doc_id``.

A document's failures are a mask of five bits, and every figure of every order follows from
the number of documents of each (part, mask, labels): masks are additive.  So one table of at
most 128 counters a part is all that the 120 orders need.

Only filter E looks across documents.  Its prepass is a counting Bloom filter: every task
counts the cells of its texts' hashes, the tasks' sketches are summed block by block, and a
text with any cell that was hit once is unique for certain.  Only the other texts, the
possible repeats, are shuffled, whole, to find each text's least ``doc_id``.

Jobs: count rows -> sketch (hashes only) -> flags, with the text beside them only for
possible repeats -> least ids of those -> counters -> orders.  The merged sketch is sent to
every task as one bit a cell, ``MOST_CELLS / 8`` = 32 MB at most; a corpus too large for
that many cells has more possible repeats, never another result.  Copies of one text are
reduced to one row in each task before they move, however many there are, and the ids found
join back by ``doc_id``, never by text.

Defined cases: a null text is empty (it fails A; no words, so not B); a null ``source`` is
the empty part; a null ``doc_id`` has no smaller id and is smaller than none, so it neither
fails E nor makes others fail; rows of one ``doc_id`` and text fail E or pass it together; a
label row with null or unknown marks marks nothing, several of one ``doc_id`` mark it if any
does; other columns are ignored; an empty table has no part and gives no row.
"""

from __future__ import annotations

from itertools import permutations
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Sketch cells to a row, and bounds on their number (a power of two).
CELLS_A_ROW, LEAST_CELLS, MOST_CELLS = 8, 1 << 16, 1 << 28
#: Cells in one block of the sketch: what a task sends, and holds at a time when summing.
BLOCK = 1 << 16
#: Cells of a text.
HASHES = 3
#: Rows whose cells a task holds before it sends them on.
FLUSH_ROWS = 1 << 20

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))


def local_mask(raw: bytes) -> int:
    """Bits of the failures of A, B, C and D (1, 2, 4, 8)."""
    words = raw.split()
    n, size = len(words), len(raw)
    upper = size - len(raw.translate(None, CAPITALS))
    return ((n < 200) | (100 * len(set(words)) < 50 * n) << 1
            | (100 * upper > 2 * len(raw.translate(None, CONTINUATION))) << 2
            | (len(raw.translate(None, MARKS)) < size) << 3)


# --- counting Bloom filter ---------------------------------------------------

def n_cells(rows: int) -> int:
    """Cells for so many rows."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (max(1, CELLS_A_ROW * rows) - 1).bit_length()))


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """(HASHES, n) cells of 64-bit hashes, by double hashing."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(low + np.uint64(k) * high) & np.uint64(cells - 1) for k in range(HASHES)]).astype(np.int64)


def _sketch_job(cells: int):
    """Counts of the cells that one partition hit, by block, flushed before they grow large."""
    def flush(hashes: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(cells_of(np.concatenate(hashes), cells).ravel(), return_counts=True)
        cuts = np.flatnonzero(np.diff(at // BLOCK)) + 1
        parts = list(zip(np.split(at, cuts), np.split(np.minimum(n, 255).astype(np.uint8), cuts))) if len(at) else []
        return pa.RecordBatch.from_pydict({
            "block": pa.array([int(p[0]) // BLOCK for p, _ in parts], pa.int64()),
            "cells": pa.array([(p % BLOCK).astype("<u2").tobytes() for p, _ in parts], pa.binary()),
            "counts": pa.array([k.tobytes() for _, k in parts], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks_of((b.column(0).to_numpy() for b in batches), len, FLUSH_ROWS):
            yield flush(part)
    return run


def _merge_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketches, which come ordered by block: one bit a cell that was hit twice."""
    at, total = None, np.zeros(BLOCK, dtype=np.uint8)

    def done():
        return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()),
                                           "twice": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})

    for b in batches:
        for block, cells, counts in zip(*C.columns(b, "block", "cells", "counts")):
            if block != at:
                if at is not None:
                    yield done()
                at, total = block, np.zeros(BLOCK, dtype=np.uint8)
            where, more = np.frombuffer(cells, dtype="<u2"), np.frombuffer(counts, dtype=np.uint8)
            total[where] += np.minimum(more, 255 - total[where])  # counters stop at 255
    if at is not None:
        yield done()


def repeat_bits(hashes: DataFrame, cells: int) -> np.ndarray:
    """The merged sketch of a one-column table of hashes: packed bits, cells // 8 bytes."""
    merged = hashes.mapInArrow(_sketch_job(cells), "block long, cells binary, counts binary") \
        .repartition("block").sortWithinPartitions("block").mapInArrow(_merge_job, "block long, twice binary")
    bits = np.zeros(cells // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():  # at most MOST_CELLS / 8 bytes, whatever the input
        own = bits[r.block * BLOCK // 8:(r.block + 1) * BLOCK // 8]
        own[:] = np.frombuffer(r.twice, dtype=np.uint8)[:len(own)]
    return bits


def may_repeat(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have no cell that was hit only once."""
    out = np.ones(len(hashes), dtype=bool)
    for at in cells_of(hashes, 8 * len(bits)):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


# --- flags -------------------------------------------------------------------

def _flag_job(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = dict(zip(b.schema.names, b.columns))
            repeats = may_repeat(col["hash"].to_numpy(), bits.value)
            texts = col["text"].cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": col["doc_id"], "part": col["part"], "hash": col["hash"],
                "mask": pa.array([local_mask(t) for t in texts], pa.int32()),
                "repeat": pc.if_else(pa.array(repeats), col["text"], pa.scalar(None, col["text"].type)),
            })
    return run


def document_masks(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """doc_id, part and mask (bits A=1 .. E=16) of every row of ``docs`` (doc_id, text, source)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"))
    hashes = rows.select(F.xxhash64("text").alias("hash"))
    bits = spark.sparkContext.broadcast(repeat_bits(hashes, n_cells(docs.count())))
    flags = C.cut(spark, rows.withColumn("hash", F.xxhash64("text")).mapInArrow(
        _flag_job(bits), "doc_id long, part string, hash long, mask int, repeat string"), "op12-flags")
    bits.unpersist()
    repeats = flags.where("repeat is not null")
    # One row a text: its least id.  Texts only meet here, copies already reduced in each task.
    firsts = C.cut(spark, repeats.groupBy("hash", "repeat").agg(F.min("doc_id").alias("doc_id"))
                   .where("doc_id is not null").select("hash", "doc_id", F.lit(True).alias("first")), "op12-first")
    late = repeats.select("doc_id", "part", "hash", "mask").join(firsts, ["hash", "doc_id"], "left") \
        .select("doc_id", "part", F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.col("mask") + 16)
                .otherwise(F.col("mask")).alias("mask"))
    return flags.where("repeat is null").select("doc_id", "part", "mask").unionAll(late)


# --- orders ------------------------------------------------------------------

def _tables() -> dict[str, np.ndarray]:
    """For each figure a 0/1 table: row (order, step) by mask, which masks count there."""
    masks = np.arange(32)
    out = {k: np.zeros((len(ORDERS), 5, 32), dtype=np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    for o, order in enumerate(ORDERS):
        before = 0
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails = masks & bit > 0
            out["removed"][o, s] = fails & (masks & before == 0)
            out["redundant"][o, s] = fails & (masks & before > 0)
            out["unique_fails"][o, s] = masks == bit
            before |= bit
            out["kept"][o, s] = masks & before == 0
    return out


def _order_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _tables()
    letter = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    orders, steps = [o for o in ORDERS for _ in FILTERS], list(range(1, 6)) * len(ORDERS)
    for b in batches:
        for part, cells in zip(*C.columns(b, "part", "cells")):
            count = np.zeros((32, 2, 2), dtype=np.int64)  # by mask, good, toxic
            for c in cells:
                count[c["mask"], c["good"], c["toxic"]] = c["n"]
            got = {k: t @ count.sum((1, 2)) for k, t in tables.items()}
            got["good_lost"] = tables["removed"] @ count[:, 1].sum(1)
            got["toxic_lost"] = tables["removed"] @ count[:, :, 1].sum(1)
            share = np.zeros(5, dtype=np.int64)
            np.add.at(share, letter.ravel(), got["removed"].ravel())
            got["shapley"] = share[letter]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(orders)), "filter_order": pa.array(orders), "step": pa.array(steps, pa.int32()),
                **{k: pa.array(got[k].ravel(), pa.int64()) for k in FIGURES}})


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in FIGURES)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic (0/1) and n: documents of each kind."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
                          F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")).where("doc_id is not null and (good or toxic)")
    # Written, so that the join below has a plain exchange on both sides, which AQE can split.
    marks = C.cut(spark, marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "op12-labels")
    bit = {k: F.coalesce(F.col(k).cast("int"), F.lit(0)).alias(k) for k in ("good", "toxic")}
    return document_masks(docs).join(marks, "doc_id", "left").select("part", "mask", *bit.values()) \
        .groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, filter order and step with its figures (600 rows a part)."""
    cells = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    return cells.mapInArrow(_order_job, SCHEMA)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over ``documents``, by ``source``."""
    return audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
      FROM b p, b q, b r, b s, b t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
st AS (SELECT filter_order, step, bits[step] AS bit, list_sum(list_slice(bits, 1, step - 1)) AS earlier
       FROM (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
sums AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER ((mask & (coalesce(earlier, 0)::INT | bit)) = 0) AS kept,
    sum(n) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) = 0) AS removed,
    sum(n) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(g) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) = 0) AS good_lost,
    sum(x) FILTER ((mask & bit) > 0 AND (mask & coalesce(earlier, 0)::INT) = 0) AS toxic_lost
  FROM c, st GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM sums
"""
