"""Operator 7: token ids in a byte-aligned store with frequency-ranked ids.

Every id is replaced by its rank in the corpus (0 = most frequent), and ranks are
written in 1 to 4 whole bytes.  The byte counts stand apart from the bytes: one
control byte holds the 2-bit lengths of four ids.  A reader expands control bytes
through a 256-row lookup table and gathers the data bytes with numpy, no loop.

Jobs: encode once and store the ids (input order) -> count ids over all
documents -> deal documents by ascending ``doc_id`` and write blocks -> read back.
A block is one Parquet row holding whole documents, so any store Spark can write
to holds the file, and a lost task rewrites only its own part.

Defined cases: a null text is empty (its only id is the end id); a null
``doc_id`` sorts first; rows of one ``doc_id`` are ordered by length and ids;
an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import chain, compress, repeat
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

END_ID = 1
#: Pieces of words kept per Python worker (about 90 MB).
MEMO_PIECES = 600_000
#: Ids in a block, a little more at most than the last document adds.
BLOCK_IDS = 1 << 16
#: Ids counted at a time, likewise.
COUNT_IDS = 1 << 18
#: Letters that stay letters when normalised, and punctuation: a run of either is a pre-token.
LETTERS = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))
TAIL = ".,;:!?&%$#*|-"


class WordIds:
    """Ids of pieces of words, kept for reuse inside one Python worker: a piece's number leads to
    its ids in one array, so the ids of a whole batch are gathered by numpy.

    At most ``limit`` pieces are kept: a batch that would exceed it first drops those that did not
    come again since the last time, then all but its own, so memory is bounded by that and by a batch."""

    def __init__(self, model, whole, limit: int):
        """``model``: ids of normalised letters or punctuation, ``whole``: of any word; both of many
        pieces at once, as a flat array and the number of ids of each."""
        self.model, self.whole, self.limit = model, whole, limit
        self.clear()

    def numbers(self, plain: list[str], odd: list[str]) -> np.ndarray:
        """The number of each of ``plain`` (for ``model``) and ``odd`` (for ``whole``), which all differ."""
        C.PieceMemo.take(self)
        pieces = plain + odd
        got = np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        self.again[got[got >= 0]] = True
        if len(self.known) + np.count_nonzero(got < 0) > self.limit and self.known:
            self._keep(self.again[:len(self.known)], np.count_nonzero(got < 0), got)
            got = np.fromiter(map(self.known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        miss = np.flatnonzero(got < 0)
        if len(miss):
            n = int(np.searchsorted(miss, len(plain)))
            new = [pieces[i] for i in miss.tolist()]
            got[miss] = len(self.known) + np.arange(len(miss))
            for coded, some in ((self.model, new[:n]), (self.whole, new[n:])):
                if some:
                    self._add(some, *coded(some))
        return got

    def _keep(self, again: np.ndarray, more: int, own: np.ndarray) -> None:
        """Drop pieces until half of ``limit`` and the ``more`` new ones are enough, if that can be."""
        if np.count_nonzero(again) > min(self.limit // 2, self.limit - more):
            again = np.zeros(len(again), dtype=bool)
            again[own[own >= 0]] = True
        kept = list(compress(self.known, again.tolist()))
        ids, ends = self.gather(np.flatnonzero(again))
        self.clear()
        self._add(kept, ids, np.diff(ends, prepend=0))

    def _add(self, pieces: list[str], fresh: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.known), len(pieces)
        need = self.used + len(fresh)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(2 * need - self.used, dtype="<u4")])
        if first + n > len(self.ends):
            self.ends = np.concatenate([self.ends[:first], np.zeros(first + 2 * n, dtype=np.int64)])
            self.again = np.concatenate([self.again[:first], np.zeros(first + 2 * n, dtype=bool)])
        self.ids[self.used:need] = fresh
        self.ends[first:first + n] = self.used + np.cumsum(sizes)
        self.known.update(zip(pieces, range(first, first + n)))
        self.used = need

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a sequence of pieces, and where each piece's ids end among them."""
        return _gather(self.ids, self.ends, numbers)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 16, dtype=np.int64), 0
        self.again = np.zeros(1 << 16, dtype=bool)  # pieces that came in a later batch too


def _gather(ids: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` that end at ``ends``, in the order of ``numbers``, and where each ends then."""
    start = np.where(numbers > 0, ends[numbers - 1], 0)
    length = ends[numbers] - start
    out_ends = np.cumsum(length)
    total = int(out_ends[-1]) if len(out_ends) else 0
    at = np.repeat(start - out_ends + length, length)
    at += np.arange(total)
    return ids[at], out_ends


_WORDS: dict[str, WordIds] = {}


def _words(tokenizer_path: str) -> WordIds:
    if tokenizer_path not in _WORDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        specials = {t.content: i for i, t in sorted(tok.get_added_tokens_decoder().items()) if t.special}
        mark = next(iter(specials), None)  # an added token never joins its neighbours
        mark_id = specials.get(mark)

        def marked(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces of one call are joined by a special token and split at its id."""
            out: list = [None] * len(pieces)
            rest = [i for i, p in enumerate(pieces) if mark is not None and mark not in p]
            for k in range(0, len(rest), 2000):
                part = rest[k:k + 2000]
                ids = np.asarray(tok.encode(mark.join([pieces[i] for i in part]), add_special_tokens=False).ids, dtype="<u4")
                for i, got in zip(part, np.split(ids, np.flatnonzero(ids == mark_id))):
                    out[i] = got[1:] if len(got) and got[0] == mark_id else got
            return _flat([tok.encode(p, add_special_tokens=False).ids if o is None else o for p, o in zip(pieces, out)])

        _WORDS[tokenizer_path] = WordIds(_pretoken_ids(tok), marked, MEMO_PIECES)
    return _WORDS[tokenizer_path]


def _flat(coded: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    return np.fromiter(chain.from_iterable(coded), dtype="<u4", count=int(sizes.sum())), sizes


def _pretoken_ids(tok):
    """Ids of pre-tokens of lower-case LETTERS or of TAIL, straight from the tokenizer's model, or None
    if its normaliser or pre-tokenizer doesn't treat each character for itself and its case as nothing."""
    table = {}
    for c in LETTERS + TAIL:
        if tok.normalizer is None or tok.pre_tokenizer is None:
            return None
        found = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(c))
        if len(found) != 1:
            return None
        table[ord(c)] = found[0][0]
    small = _lower(pa.array([*LETTERS])).to_pylist()
    if any(table.get(ord(s)) != table[ord(c)] for c, s in zip(LETTERS, small)):
        return None
    tokenize, as_is = tok.model.tokenize, all(table[ord(c)] == c for c in [*small, *TAIL] if c.isascii())
    samples = [LETTERS[i:i + 7] for i in range(0, len(LETTERS), 7)] + [TAIL, TAIL[::-1], "word", "WORD", *LETTERS, *TAIL]

    def ids(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, ends = array("I"), []
        for p in parts:
            for token in tokenize(p if as_is and p.isascii() else p.translate(table)):
                out.append(token.id)
            ends.append(len(out))
        return np.frombuffer(out, dtype="<u4"), np.diff(np.array(ends, dtype=np.int64), prepend=0)

    want = _flat([tok.encode(x, add_special_tokens=False).ids for x in samples])
    return ids if all(map(np.array_equal, ids(_lower(pa.array(samples)).to_pylist()), want)) else None


def _lower(words: pa.Array) -> pa.Array:
    return pc.utf8_lower(words)


def _distinct(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The different ones of ``words``, and for each its place among them."""
    coded = words.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


def _word_ids(words: pa.Array, store: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different words one after the other, and where each word's end.

    A word of plain letters with or without punctuation behind is two pieces, its letters (in
    lower case) and its punctuation, which come again in other words; any other word is one."""
    if store.model is None:
        return store.gather(store.numbers([], words.to_pylist()))
    core, tail = pc.utf8_rtrim(words, TAIL), pc.utf8_ltrim(words, LETTERS)
    # the first run of letters ends where the last run of punctuation begins
    plain = pc.equal(pc.add(pc.binary_length(core), pc.binary_length(tail)), pc.binary_length(words))
    cores, core_at = _distinct(pa.concat_arrays([_lower(core.filter(plain)), tail.filter(plain)]))
    odd = words.filter(pc.invert(plain)).to_pylist()  # never letters or punctuation alone, so no piece of the others
    numbers = store.numbers(cores, odd)
    is_plain = plain.to_numpy(zero_copy_only=False)
    pieces = np.full((len(words), 2), -1, dtype=np.int64)
    pieces[is_plain] = numbers[core_at].reshape(2, -1).T
    pieces[~is_plain, 0] = numbers[len(cores):]
    flat = pieces.ravel()
    used = np.flatnonzero(flat >= 0)
    ids, ends = store.gather(flat[used])
    last = np.cumsum(np.where(is_plain, 2, 1)) - 1  # each word's last piece
    return ids, ends[last]


def encode_column(texts: pa.Array, tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other (end ids included), and where each text's end;
    equal to encoding each whole text at once.

    The texts are split and their words numbered in Arrow; only pieces of words that differ are
    looked up, only new ones are encoded, and the ids are gathered by numpy."""
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    own_ids, own_ends = _word_ids(coded.dictionary, _words(tokenizer_path))
    ids, word_ends = _gather(own_ids, own_ends, coded.indices.to_numpy())
    behind = words.offsets.to_numpy() - words.offsets[0].as_py()
    text_ends = np.concatenate([[0], word_ends])[behind[1:]]
    out = np.full(len(ids) + len(texts), END_ID, dtype="<u4")
    own = np.ones(len(out), dtype=bool)
    ends = text_ends + np.arange(1, len(texts) + 1)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


def encode_texts(found: list[str], tokenizer_path: str) -> Iterator[np.ndarray]:
    """Ids of each text, end id included."""
    ids, ends = encode_column(pa.array(found, pa.string()), tokenizer_path)
    return iter(np.split(ids, ends[:-1])) if found else iter(())


def _ids_job(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            if not b.num_rows:
                continue
            ids, ends = encode_column(b.column(b.schema.get_field_index("text")), tokenizer_path)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(b.schema.get_field_index("doc_id")), "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids": pa.array([press.compress(_narrow(ids[x:y])) for x, y in zip(starts.tolist(), ends.tolist())], pa.binary()),
            })
    return run


def _narrow(ids: np.ndarray) -> bytes:
    """A width byte, then the ids in 2 bytes each where all fit, else in 4."""
    return b"\x02" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 65536 else b"\x04" + ids.tobytes()


def _widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2" if blob[0] == 2 else "<u4", offset=1)


def _count_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id counts of one partition."""
    open_, total = zstandard.ZstdDecompressor(), np.zeros(0, dtype=np.int64)
    found = (_widen(open_.decompress(blob)) for b in batches for blob in C.columns(b, "ids")[0])
    for part in C.chunks_of(found, len, COUNT_IDS):  # a count is as long as the vocabulary: not one a document
        got = np.bincount(np.concatenate(part), minlength=len(total))
        got[:len(total)] += total
        total = got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})


# --- byte-aligned coding -----------------------------------------------------

#: Control byte -> lengths of its four values.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.concatenate([code, np.zeros(-len(code) % 4, dtype=np.uint8)]).reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind ``pack``'s two byte strings, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    at = ends - lengths
    out = raw[at].astype("<u4")
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def _block_job(ranked: np.ndarray):
    """Blocks of the documents of one partition, which come in ascending order."""
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype="<u4")
    rank[ranked] = np.arange(len(ranked), dtype="<u4")

    def rows(batches):
        for b in batches:
            yield from zip(*C.columns(b, "doc_id", "part", "n_tokens", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, before, block = zstandard.ZstdDecompressor(), 0, 0
        for part in C.chunks_of(rows(batches), lambda r: r[2], BLOCK_IDS):
            ids = np.concatenate([_widen(open_.decompress(r[3])) for r in part])
            control, data = pack(rank[ids])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part[0][1]], pa.int32()), "block": pa.array([block], pa.int64()),
                "first": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([[r[0] for r in part]], pa.list_(pa.int64())),
                "counts": pa.array([[r[2] for r in part]], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
            })
            before, block = before + len(ids), block + 1
    return run


BLOCK_SCHEMA = ("part int, block long, first long, n_ids long, doc_ids array<long>, counts array<long>, "
                "control binary, data binary")


def write_store(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encode ``docs`` (doc_id, text) and write the store: ``path``/blocks and ``path``/ranks.

    The one broadcast is the rank table: one row per id of the vocabulary."""
    spark = docs.sparkSession
    C.small_batches(spark)
    coded = C.cut(spark, C.texts(docs).mapInArrow(_ids_job(tokenizer_path), "doc_id long, n_tokens long, ids binary"),
                  "op7-ids", "uncompressed")
    counts = coded.select("ids").mapInArrow(_count_job, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = np.array([r.id for r in counts.orderBy(F.desc("n"), "id").collect()], dtype=np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ranked)], "rank long, id long").write.parquet(f"{path}/ranks")
    dealt = coded.repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids") \
        .withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(_block_job(ranked), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    C.drop(spark, coded)


def _read_job(ranked: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, n, docs, counts, control, data in zip(*C.columns(b, "start", "n_ids", "doc_ids", "counts", "control", "data")):
                ids = ranked[unpack(control, data, n)]
                ends = np.cumsum(counts)
                each = [ids[e - c:e] for e, c in zip(ends, counts)]
                out = {
                    "doc_id": pa.array(docs, pa.int64()),
                    "start": pa.array(start + ends - np.array(counts), pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(e.tobytes()) for e in each], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([e.astype(np.int64) for e in each], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
    return run


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``) of every document of a store.

    A block stores its start inside its part; the parts' own totals, one row a part,
    are summed up in order and joined back."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    ranked = np.array([r.id for r in ranks] or [0], dtype="<u4")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    at = blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return at.mapInArrow(_read_job(ranked, with_ids), schema)


def op7_token_store(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Every document of ``documents`` written to a store and read back from it."""
    import public_tokenizers

    path = C.shared_path(spark, "op7-store")
    write_store(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path(tokenizer))
    return read_store(spark, path)
