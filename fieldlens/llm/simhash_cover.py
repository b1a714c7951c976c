"""Operator 5: SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code of the 64-bit space, a product of block
codes: two binary Golay codes (23 bits, radius 3), one Hamming code (15 bits,
radius 1) and 3 plain bits (radius 0).  Each block code is perfect, so a block has
exactly one anchor within its covering radius.

Two fingerprints x and y at distance 2 or less have a point z with d(x, z) <= 1 and
d(z, y) <= 1 (turn one of the differing bits).  The anchor of z lies, in every
block, within the block's covering radius of z, so within radius plus (bits turned
in that block) of x and of y.  Hence every fingerprint is replicated to all anchors
within covering radius plus its half of the threshold (1 of 2), where the extra bit
may fall in any block: about 19 anchors.  Every linked pair then meets at an anchor;
the exact distance check there drops the rest.

Copies never travel: rows are grouped to distinct fingerprints first.  At an anchor
the distinct fingerprints are compared in blocks and only a spanning star of each
local class leaves the task.

An anchor with more than ``CROWD`` distinct fingerprints (very many near copies of one
text) is not compared in one task.  Its fingerprints are dealt again by the midpoints
themselves, the points within 1 bit of each: two fingerprints share such a point exactly
if they differ in 2 bits or fewer, and a point has at most 65 of them, so no group there
can grow.  Every pair of a crowded anchor is found that way, every other pair at its anchor.

Defined cases: null and empty texts have fingerprint 0 and link like any other;
every input row gives one row, repeated ids included; a null id never is a class id
(a class of null ids only has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Shingles whose bits are summed at once: bounds memory for very long texts.
CHUNK = 1 << 16
#: Rows of a comparison block.
COMPARE = 512
#: Distinct fingerprints of one anchor that are compared in one task; more are dealt by midpoints.
CROWD = 512

# --- fingerprints --------------------------------------------------------------


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the ``width``-word shingles (repeats included) of ``text``."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, CHUNK):
        spans = zip(starts[k:min(n, k + CHUNK)].tolist(), (ends[k + width - 1:min(n, k + CHUNK) + width - 1] - 1).tolist())
        hashes = np.array([h(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_job(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = C.columns(b, "doc_id", "text")
            prints = np.array([fingerprint(t, width) for t in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(prints)})
    return run


# --- the covering code -----------------------------------------------------------


class PerfectBlock:
    """One block code by syndrome decoding.  ``checks[i]``: syndrome of bit i."""

    def __init__(self, shift: int, bits: int, checks: list[int], radius: int):
        self.shift, self.bits, self.checks = shift, bits, checks
        width = max(1, bits and max(c.bit_length() for c in checks)) if radius else 1
        # leader[s]: the error of least weight with syndrome s
        self.leader = np.zeros(1 << width if radius else 1, dtype=np.uint64)
        for r in range(1, radius + 1):
            for at in combinations(range(bits), r):
                s = 0
                for i in at:
                    s ^= checks[i]
                self.leader[s] = sum(1 << i for i in at)
        # syndromes of all words by bytes of the block
        self.by_byte = np.zeros((-(-bits // 8), 256), dtype=np.uint32)
        for k in range(self.by_byte.shape[0]):
            for v in range(256):
                s = 0
                for i in range(8):
                    if v >> i & 1 and 8 * k + i < bits:
                        s ^= checks[8 * k + i] if radius else 0
                self.by_byte[k, v] = s

    def anchor(self, words: np.ndarray) -> np.ndarray:
        """The code word nearest to each block word."""
        s = np.zeros(words.shape, dtype=np.uint32)
        for k in range(self.by_byte.shape[0]):
            s ^= self.by_byte[k, (words >> np.uint64(8 * k) & np.uint64(255)).astype(np.intp)]
        return words ^ self.leader[s]

    def of(self, prints: np.ndarray) -> np.ndarray:
        return prints >> np.uint64(self.shift) & np.uint64((1 << self.bits) - 1)


def _golay_checks() -> list[int]:
    """Syndromes of the 23 bits: x^i modulo the generator x^11+x^10+x^6+x^5+x^4+x^2+1."""
    generator, out = 0b110001110101, []
    for i in range(23):
        r = 1 << i
        while r.bit_length() > 11:
            r ^= generator << (r.bit_length() - 12)
        out.append(r)
    return out


BLOCKS = [PerfectBlock(0, 23, _golay_checks(), 3), PerfectBlock(23, 23, _golay_checks(), 3),
          PerfectBlock(46, 15, list(range(1, 16)), 1), PerfectBlock(61, 3, [0, 0, 0], 0)]


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius plus 1 of each fingerprint.

    An anchor is that near exactly if it is the anchor of the fingerprint itself or of
    one of its 64 one-bit neighbours, because every block code is perfect."""
    n = len(prints)
    home = np.zeros(n, dtype=np.uint64)
    parts = []
    for b in BLOCKS:
        words = b.of(prints)
        own = b.anchor(words)
        flips = np.uint64(1) << np.arange(b.bits, dtype=np.uint64)
        near = b.anchor(words[:, None] ^ flips[None, :])
        parts.append((b.shift, own, near))
        home |= own << np.uint64(b.shift)
    rows, found = [np.arange(n)], [home]
    for shift, own, near in parts:
        near = np.sort(near, axis=1)
        new = near != own[:, None]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        found.append(home[r] ^ (own[r] << np.uint64(shift)) ^ (near[r, c] << np.uint64(shift)))
    return np.concatenate(rows), np.concatenate(found)


def _anchor_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        rows, found = anchors(prints)
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(found.view(np.int64)), "fp": pa.array(prints[rows].view(np.int64))})


def local_classes(prints: np.ndarray, bits: int) -> np.ndarray:
    """Least index linked to each distinct fingerprint at one anchor, directly or by others."""
    root = np.arange(len(prints))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(0, len(prints), COMPARE):
        for m in range(k, len(prints), 1 << 14):
            rest = prints[m:m + (1 << 14)]
            r, c = np.nonzero(np.bitwise_count(prints[k:k + COMPARE, None] ^ rest[None, :]) <= bits)
            for i, j in zip((r + k)[(c + m) > (r + k)].tolist(), (c + m)[(c + m) > (r + k)].tolist()):
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(prints))])


def _compare_job(bits: int):
    """Star edges (fp, least fp of its local class) of each anchor; rows come sorted by anchor."""
    def links(anchor: np.ndarray, prints: np.ndarray):
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        ends = np.concatenate([cuts, [len(anchor)]])
        starts = np.concatenate([[0], cuts])
        u, v = [], []
        for a, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            group = prints[a:e]
            if e - a == 2:
                if int(np.bitwise_count(group[0] ^ group[1])) <= bits:
                    u.append(group[1:])
                    v.append(group[:1])
                continue
            root = local_classes(group, bits)
            far = np.flatnonzero(root != np.arange(e - a))
            u.append(group[far])
            v.append(group[root[far]])
        if u:
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(u).view(np.int64)), "v": pa.array(np.concatenate(v).view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            a = np.concatenate([held_a, b.column(0).to_numpy(zero_copy_only=False)])
            p = np.concatenate([held_p, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            yield from links(a[:last], p[:last])
            held_a, held_p = a[last:], p[last:]
        yield from links(held_a, held_p)
    return run


def _midpoint_job(bits: int):
    """(bit, point, fp): fingerprints share a point exactly if they differ in ``bits`` bits or fewer.

    For 2 bits the points are those within 1 bit (``bit`` is 0); for 1 bit they are the
    fingerprint without bit i, for each i; for 0 bits there are none to share."""
    turned = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            points = np.column_stack([prints, prints[:, None] ^ turned]) if bits == 2 else prints[:, None] & ~turned
            if bits == 0:
                points = points[:, :0]
            bit = np.zeros(points.shape, np.int32) if bits == 2 else np.broadcast_to(np.arange(points.shape[1], dtype=np.int32), points.shape)
            yield pa.RecordBatch.from_pydict({"bit": pa.array(bit.ravel()), "point": pa.array(points.ravel().view(np.int64)),
                                              "fp": pa.array(np.repeat(prints, points.shape[1]).view(np.int64))})
    return run


def _links(spark: SparkSession, distinct: DataFrame, bits: int, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that connect the fingerprints linked at any anchor."""
    dealt = distinct.mapInArrow(_anchor_job, "anchor long, fp long")
    crowded = C.cut(spark, dealt.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "op5-crowded")
    quiet = dealt.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    points = dealt.join(crowded, "anchor", "left_semi").select("fp").distinct().mapInArrow(_midpoint_job(bits), "bit int, point long, fp long")
    # All fingerprints of a point are linked to each other: 65 at most, so a set of them is small.
    stars = points.groupBy("bit", "point").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    return quiet.mapInArrow(_compare_job(bits), "u long, v long") \
        .unionByName(stars.select(F.explode("near").alias("u"), "v").where("u <> v"))


def _classes(marked: DataFrame, bits: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``marked``."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the anchors cover distances of 0 to 2 bits")
    spark = marked.sparkSession
    distinct = C.cut(spark, marked.select("fp").distinct(), "op5-distinct", rows=marked.count())
    n = distinct.count()
    roots = components(spark, _links(spark, distinct, bits), "op5-edges", n)  # a few edges a fingerprint at most
    return C.cut(spark, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                 .select("fp", F.coalesce("root", "fp").alias("root")), "op5-classes", rows=n)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    ``bits`` is at most 2, the distance for which the anchors are complete."""
    spark = docs.sparkSession
    C.small_batches(spark)
    marked = C.cut(spark, C.texts(docs).mapInArrow(_fingerprint_job(width), "doc_id long, fp long"), "op5-fp")
    classed = _classes(marked, bits)
    # The least id of a class by its fingerprints' least ids; both sides of the last join are
    # plain scans, so a fingerprint with very many copies can be split.
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = classed.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = C.cut(spark, classed.join(ids, "root").select("fp", "component_id"), "op5-ids", rows=classed.count())
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs``, all columns, of each class: the one of least id (null ids last,
    then by the hash of the text); of equal rows one stays."""
    spark = docs.sparkSession
    C.small_batches(spark)
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(key.alias("doc_id"), "text", text.alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t or "", width) for t in C.columns(b, "text")[0]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(prints)], ["doc_id", "text_key", "fp"])

    marked = C.cut(spark, keyed.mapInArrow(run, "doc_id long, text_key long, fp long"), "op5-fp")
    classed = _classes(marked, bits)
    first = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    chosen = classed.join(first, "fp").groupBy("root").agg(F.min("first").alias("first"))
    a, b = (next(n for n in (c + "_" * k for k in range(99)) if n.lower() not in map(str.lower, docs.columns)) for c in ("id", "key"))
    chosen = C.cut(spark, chosen.select(F.col("first.doc_id").alias(a), F.col("first.text_key").alias(b)), "op5-first")
    # Texts are dealt once, by the key that also removes equal rows.
    return docs.withColumns({a: key, b: text}).join(chosen, [a, b], "left_semi").dropDuplicates([a, b]) \
       .select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of every document: 3-word shingles, 2 bits."""
    return near_duplicates(C.table(spark, sf_dir, "documents"))
