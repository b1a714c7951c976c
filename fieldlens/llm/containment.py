"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside long documents: of an item's distinct word
shingles, a share of at least ``threshold`` stands in the document.

Items are partitioned by their number of shingles (classes of doubling size).  Every
item is kept as its bottom-k MinHash sketch, its k shingles of least hash, and k
follows from the class: an item of n <= u shingles that is contained to the threshold
misses at most floor((1 - threshold) n) of them, so with k = floor((1 - threshold) u) + 1
at least one sketch member stands in the document.  Hence a look-up of every shingle of
every document among the sketches finds all candidates, however long the document is; a
candidate is then verified by its exact shingles.

Documents are never moved: each task slides over whole texts and looks up its hashes in
the items' sketches.  Items come in blocks of bounded size, one pass over the documents
each; a block's broadcast is given up before the next one is made, so what is held has a
proven bound however large the benchmark is.

Defined cases: texts are lower-cased, words stand between white space; an item of fewer
words than a shingle is one shingle of all its words, an item without words (or null) is
in no document; a null document is empty and contains nothing; repeated rows give repeated
result rows; items of equal text are found each; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain, islice
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
THRESHOLD = 0.8
#: Words of items in one broadcast block (some 100 MB at most in a worker).
BLOCK_WORDS = 1_000_000
#: An odd base makes every power invertible modulo 2^64.
BASE = 0x9E3779B97F4A7C15
FILTER_BITS = 22
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", b" " * 9)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest text so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))]), dtype=np.uint64)
                          for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def normal(text: str) -> bytes:
    """Lower case, single blanks between words."""
    raw = text.lower()
    if not raw.isascii() and any(c.isspace() and ord(c) > 127 for c in set(raw)):
        raw = " ".join(raw.split())
    t = raw.encode("utf-8", "replace").translate(_BLANKS)
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t.strip(b" ")


class Shingles:
    """Word shingles of one normalised text: where they stand, and their hashes."""

    def __init__(self, text: bytes):
        self.text = text
        if not text:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
            return
        raw = np.frombuffer(text, dtype=np.uint8)
        blanks = np.flatnonzero(raw == 32)
        self.starts, self.ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(raw)]])
        powers, self.inverse = _powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:len(raw)], dtype=np.uint64)])

    def spans(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(self.starts) - width + 1)
        return self.starts[:n], self.ends[width - 1:width - 1 + n]

    def hashes(self, width: int) -> np.ndarray:
        """Sum of byte * base^(place in the shingle), mixed; equal shingles, equal hashes."""
        s, e = self.spans(width)
        if not len(s):
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = (self.sums[e] - self.sums[s]) * self.inverse[s]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            return h ^ h >> np.uint64(29)


class ItemBlock:
    """Sketches and shingles of one block of items."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.threshold = threshold
        self.items, sketches = [], {}
        for item_id, text in items:
            t = Shingles(normal(text or ""))
            w = min(width, len(t.starts))
            if not w:
                continue
            h, (s, e) = t.hashes(w), t.spans(w)
            found = {t.text[a:b]: x for a, b, x in zip(s.tolist(), e.tolist(), h.tolist())}
            n = len(found)
            upper = (1 << n.bit_length()) - 1  # the largest size of the item's class
            k = math.floor((1 - threshold) * upper + 1e-9) + 1
            at = len(self.items)
            self.items.append((item_id, w, set(found), np.array(sorted(set(found.values())), dtype=np.uint64)))
            for x in sorted(set(found.values()))[:k]:
                sketches.setdefault(w, {}).setdefault(x, []).append(at)
        self.lookup = {}
        for w, members in sketches.items():
            keys = np.array(sorted(members), dtype=np.uint64)
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.lookup[w] = (bits, keys, [members[x] for x in keys.tolist()])

    def found(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, shingles found, shingles of the item) of every item contained."""
        t, out = Shingles(normal(text)), []
        for w, (bits, keys, owners) in self.lookup.items():
            h = t.hashes(w)
            maybe = h[bits[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]]
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(keys, maybe), len(keys) - 1)
            candidates = {i for k in set(at[keys[at] == maybe].tolist()) for i in owners[k]}
            s, e = t.spans(w) if candidates else ((), ())
            for i in sorted(candidates):
                item_id, _, shingles, own = self.items[i]
                near = np.flatnonzero(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h)
                n = len(shingles & {t.text[a:b] for a, b in zip(s[near].tolist(), e[near].tolist())})
                if n >= self.threshold * len(shingles) - 1e-9:
                    out.append((item_id, n, len(shingles)))
        return out


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``block_words`` words, streamed through the driver."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()
    yield from C.chunks_of(((r[0], r[1]) for r in rows), lambda r: 1 + (r[1] or "").count(" "), block_words)


def _pairs_job(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            rows = [(d, *f) for d, t in zip(*C.columns(b, "doc_id", "text")) for f in block.found(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                                             ["doc_id", "item_id", "n_found", "n_shingles"])
    return run


def _leaks_job(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {hashlib.sha256(t.encode()).hexdigest() for t in C.columns(b, "text")[0] if shared.value.found(t)}
            yield pa.RecordBatch.from_pydict({"text_key": pa.array(sorted(found), pa.string())})
    return run


def _by_block(docs: DataFrame, blocks: Iterator, job, schema: str, width: int, threshold: float) -> DataFrame:
    """Rows of ``job`` for every block: one pass over the documents each, written before the
    block's broadcast is given up, so one block is held at a time."""
    spark, paths = docs.sparkSession, []
    for block in blocks:
        shared = spark.sparkContext.broadcast(ItemBlock(block, width, threshold))
        paths.append(C.shared_path(spark, "op6-block"))
        C.texts(docs).mapInArrow(job(shared), schema).write.parquet(paths[-1])
        shared.destroy()
    return spark.read.schema(schema).parquet(*paths)


def _first_blocks(items: DataFrame, block_words: int) -> tuple[list, Iterator]:
    """The first two blocks (there may be fewer), and the others."""
    blocks = item_blocks(items, block_words)
    return list(islice(blocks, 2)), blocks


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_found, n_shingles, containment of every item contained in a document."""
    spark = docs.sparkSession
    C.small_batches(spark)
    schema, (head, more) = "doc_id long, item_id long, n_found long, n_shingles long", _first_blocks(items, block_words)
    if not head:
        out = spark.createDataFrame([], schema)
    elif len(head) == 1:
        out = C.texts(docs).mapInArrow(_pairs_job(spark.sparkContext.broadcast(ItemBlock(head[0], width, threshold))), schema)
    else:
        out = _by_block(docs, chain(head, more), _pairs_job, schema, width, threshold)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs``, all columns, whose ``text`` contains no item.  With one block rows
    are filtered where they are read; with several, the keys of the leaking texts are
    gathered block by block and their rows leave in one anti-join."""
    spark = docs.sparkSession
    C.small_batches(spark)
    head, more = _first_blocks(items, block_words)
    if not head:
        return docs
    if len(head) == 1:
        shared = spark.sparkContext.broadcast(ItemBlock(head[0], width, threshold))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.found(t or "") for t in C.columns(b, "text")[0]], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    leaks = _by_block(docs, chain(head, more), _leaks_job, "text_key string", width, threshold).distinct()
    key = next(n for n in ("text_key" + "_" * k for k in range(99)) if n.lower() not in map(str.lower, docs.columns))
    return docs.withColumn(key, F.sha2("text", 256)).join(leaks.withColumnRenamed("text_key", key), key, "left_anti") \
        .select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in each document."""
    return contained_items(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


#: DuckDB: five-word shingles of lower-cased texts, containment of 0.8 or more.
OP6_SQL = """
WITH b AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), i AS (
    SELECT item_id, w, CASE WHEN len(w) < 5 THEN len(w) ELSE 5 END AS k FROM b WHERE len(w) > 0
), bs AS (
    SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)
), n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
), d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), ds AS (
    SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bs))
), m AS (
    SELECT ds.doc_id, bs.item_id, count(*) AS n_found FROM bs JOIN ds USING (k, s) GROUP BY ALL
)
SELECT doc_id, item_id, n_found, n_shingles, n_found / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""
