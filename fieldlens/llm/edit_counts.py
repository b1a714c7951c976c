"""Operator 4: edit-aware token counts by segment trees of pre-tokens.

A text is cut before white space that follows a visible character; no pre-token of a
byte-level BPE tokenizer reaches across such a place, so the counts of the parts add up
to the count of the text.  Parts are gathered into leaves, and a document keeps a tree
over its leaves with the sums of characters and tokens of every subtree.

An edit finds its leaf by descending along the character sums.  Only the touched leaves
are encoded again, plus the neighbours whose cut the edit has made unsafe (boundary
context); then the sums on the paths to the root are updated.  The tree is rebuilt only
when a leaf has grown to many times its size.

Trees are rows (``leaf_chars``, ``leaf_tokens``) beside the text, so they are stored as
any table; edits come as an array a document and are applied in order.

Defined cases: a null text is empty and has no tokens; null edits are none; a place
beyond the text is its end, a deletion ends with the text, a null insertion is empty;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Parts in a new leaf, and characters beyond which a leaf makes the tree be rebuilt.
LEAF_PARTS = 32
LEAF_CHARS = 4096
MEMO_PARTS = 500_000
_PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space other than blanks and line ends: cuts beside it need care, so a text with
#: any is cut by the slower rule.
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")
_COUNTERS: dict = {}


class Counter:
    """Token counts of parts, each different part encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.memo = C.PieceMemo(self._counts, MEMO_PARTS)

    def _counts(self, parts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def counts(self, parts: list[str]) -> list[int]:
        known = self.memo.lookup(set(parts))
        return [known[p] for p in parts]


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def safe_cut(before: str, after: str) -> bool:
    """Whether a text may be cut between these two characters (either may be missing)."""
    return not before or not after or (after in " \n" and not before.isspace())


def parts_of(text: str) -> list[str]:
    """Parts of a text that starts at a safe cut; every place between them is one."""
    parts = _PARTS.findall(text)
    if not _ODD.search(text):
        return parts
    out: list[str] = []
    for p in parts:
        if out and not safe_cut(out[-1][-1], p[0]):
            out[-1] += p
        else:
            out.append(p)
    return out


class Tree:
    """Sums of characters and tokens over the leaves of one text (heap order)."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text = text
        self._build(chars, tokens)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size:self.size + self.leaves], self.tokens[self.size:self.size + self.leaves]

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last leaf for the end) and its first character."""
        i, start = 1, 0
        if at >= self.chars[1]:
            last = self.leaves - 1
            return last, self.chars[1] - self.chars[self.size + last]
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.size + leaf
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def edit(self, at: int, delete: int, insert: str, count: Counter) -> int:
        """Apply one edit; returns the characters that were encoded again."""
        at = min(max(0, at), len(self.text))
        end = min(len(self.text), at + max(0, delete))
        first, start = self.find(at)
        last, stop = self.find(max(at, end - 1))
        stop += self.chars[self.size + last]
        moved = len(insert) - (end - at)
        self.text = self.text[:at] + insert + self.text[end:]
        text, stop = self.text, stop + moved
        # Boundary context: leaves beside a cut that is no longer safe.
        while first and not (stop > start and safe_cut(text[start - 1:start], text[start:start + 1])):
            first -= 1
            start -= self.chars[self.size + first]
        while last < self.leaves - 1 and not safe_cut(text[stop - 1:stop] if stop else "", text[stop:stop + 1]):
            last += 1
            stop += self.chars[self.size + last]
        parts = parts_of(text[start:stop])
        tokens, slots = count.counts(parts), last - first + 1
        share = -(-len(parts) // slots) if parts else 0
        grown = False
        for k in range(slots):
            own = slice(k * share, (k + 1) * share)
            chars = sum(map(len, parts[own]))
            grown |= chars > LEAF_CHARS and len(parts[own]) > 4 * LEAF_PARTS
            self._set(first + k, chars, sum(tokens[own]))
        if grown:
            self._build(*leaves_of(self.text, count))
        return len(text) if grown else stop - start


def leaves_of(text: str, count: Counter) -> tuple[list[int], list[int]]:
    """Characters and tokens of the leaves of a new tree."""
    parts = parts_of(text)
    tokens = count.counts(parts)
    return ([sum(map(len, parts[k:k + LEAF_PARTS])) for k in range(0, len(parts), LEAF_PARTS)],
            [sum(tokens[k:k + LEAF_PARTS]) for k in range(0, len(parts), LEAF_PARTS)])


def build_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text, n_tokens, leaf_chars, leaf_tokens of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            ids, found = C.columns(b, "doc_id", "text")
            leaves = [leaves_of(t, count) for t in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array([sum(t) for _, t in leaves], pa.int64()),
                 pa.array([c for c, _ in leaves], pa.list_(pa.int64())), pa.array([t for _, t in leaves], pa.list_(pa.int64()))],
                ["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])
    C.small_batches(docs.sparkSession)
    return C.texts(docs).mapInArrow(run, "doc_id long, text string, n_tokens long, leaf_chars array<long>, leaf_tokens array<long>")


EDITS = "array<struct<at:bigint,del:bigint,ins:string>>"


def apply_edits(trees: DataFrame, tokenizer_path: str, with_text: bool = True) -> DataFrame:
    """Trees with an ``edits`` column (array of at, del, ins; applied in order) after the edits.

    Adds ``n_before`` and ``reencoded``, the characters encoded again."""
    schema = "doc_id long, n_before long, n_tokens long, n_edits long, reencoded long, n_chars long" + \
        (", text string, leaf_chars array<long>, leaf_tokens array<long>" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            out = []
            for doc_id, text, chars, tokens, edits in zip(*C.columns(b, "doc_id", "text", "leaf_chars", "leaf_tokens", "edits")):
                tree, redone, before = Tree(text or "", chars or [], tokens or []), 0, sum(tokens or [])
                for e in edits or []:
                    redone += tree.edit(e["at"] or 0, e["del"] or 0, e["ins"] or "", count) if e else 0
                out.append((doc_id, before, tree.total, len(edits or []), redone, len(tree.text))
                           + ((tree.text, *tree.leaf_sums()) if with_text else ()))
            types = [pa.int64()] * 6 + ([pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())] if with_text else [])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)],
                                             [x.split()[0] for x in schema.split(", ")])
    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, schema)


def derived_edits(text: Column, doc_id: Column) -> Column:
    """Three edits a document, derived from its own text: an insertion of a piece of the
    text, a deletion, and a replacement across a line or word boundary."""
    n = F.length(text)

    def draw(k: int, below: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id, n, F.lit(k)), below.cast("long"))

    def piece(k: int, most: int) -> Column:
        return F.substring(text, (draw(k, n + 1) + 1).cast("int"), draw(k + 1, F.lit(most)).cast("int"))

    def one(at: Column, gone: Column, put: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), gone.cast("long").alias("del"), put.alias("ins"))

    return F.array(one(draw(1, n + 1), F.lit(0), piece(2, 60)), one(draw(4, n + 1), draw(5, F.lit(40)), F.lit("")),
                   one(draw(6, n + 1), draw(7, F.lit(12)), F.concat(F.lit("\n"), piece(8, 30))))


def op4_edit_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Token counts of every document before and after three edits derived from it."""
    import public_tokenizers

    path = public_tokenizers.path(tokenizer)
    trees = build_trees(C.table(spark, sf_dir, "documents"), path)
    return apply_edits(trees.withColumn("edits", derived_edits(F.col("text"), F.col("doc_id"))), path, with_text=False)
