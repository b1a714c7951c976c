"""Operator 9: SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed and rebuilt for the tokenizers library: the
normaliser (precompiled character map, white-space rules), the metaspace marker with
its dummy prefix, the scores of a unigram model (or the merges of a BPE model, in order
of the scores of what they make), and byte fallback.

A text is normalised as a whole and cut where no piece of the vocabulary can reach
across; the parts are encoded in multithreaded batches, each different part once while
the worker remembers it.  The ids are those of the rebuilt model.  Parity is verified for
every part that is encoded: its ids are held against those of the sentencepiece library
(two merges of equal score could come in another order), and ``parity`` says whether a
text's are equal.  Every part is also decoded by the library and held against its text.

Defined cases: a null text is empty and has no ids; a text with characters that the model
can't give back (the marker itself, unknown characters without byte fallback) has
``round_trip`` false; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

MARK = "▁"
#: Parts kept per Python worker.
MEMO_PARTS = 400_000
#: Threads of a batch: new parts of one batch are few, so two keep a task's core busy.
THREADS = 2
#: Parts decoded in one string.
TOGETHER = 64
#: Types of pieces in the protobuf.
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


class PieceModel:
    """A SentencePiece model rebuilt for the tokenizers library."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer, decoders, models, normalizers

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules, spec = proto.normalizer_spec, proto.trainer_spec
        self.pieces = [p.piece for p in proto.pieces]
        ids = {p: i for i, p in enumerate(self.pieces)}
        self.kind, self.byte_fallback, self.unknown = spec.model_type, spec.byte_fallback, spec.unk_id
        if spec.model_type == UNIGRAM:
            model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk_id=spec.unk_id, byte_fallback=spec.byte_fallback)
        elif spec.model_type == BPE:
            model = models.BPE(ids, self._merges(proto.pieces, ids), unk_token=self.pieces[spec.unk_id], fuse_unk=True,
                               byte_fallback=spec.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are rebuilt")
        self.tokenizer = Tokenizer(model)
        steps = []
        if rules.precompiled_charsmap:
            steps.append(normalizers.Precompiled(rules.precompiled_charsmap))
        if rules.remove_extra_whitespaces:
            steps += [normalizers.Replace(_library_regex(" {2,}"), " "), normalizers.Replace(_library_regex(r"\A | \z"), "")]
        self.before = normalizers.Sequence(steps) if steps else None
        self.prefix = rules.add_dummy_prefix
        self.trims = rules.remove_extra_whitespaces
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                                   + ([decoders.Strip(" ", 1, 0)] if self.prefix else []))
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(p) for p in proto.pieces]
        # A cut may stand before a marker unless a piece has one after another character,
        # and beside a line end unless a longer piece holds one (byte fallback joins nothing).
        self.cuts = MARK in ids and not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.line_cuts = self.cuts and self.byte_fallback and not any("\n" in p for p in self.pieces)
        self.memo = C.PieceMemo(self._coded, MEMO_PARTS)

    @staticmethod
    def _bytes(p) -> bytes:
        if p.type == BYTE:
            return bytes([int(p.piece[3:-1], 16)])
        return b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()

    @staticmethod
    def _merges(pieces, ids: dict[str, int]) -> list[tuple[str, str]]:
        """Every pair of pieces that makes a piece, best score first, then by ids."""
        plain = {p.piece for p in pieces if p.type not in (UNKNOWN, CONTROL, BYTE)}
        found = [(-p.score, ids[p.piece[:k]], ids[p.piece[k:]], p.piece[:k], p.piece[k:]) for p in pieces if p.piece in plain
                 for k in range(1, len(p.piece)) if p.piece[:k] in plain and p.piece[k:] in plain]
        return [(a, b) for *_, a, b in sorted(found)]

    def normal(self, text: str) -> str:
        """Normalised text; the model sees it with markers."""
        return self.before.normalize_str(text) if self.before and text else text

    def parts(self, normal: str) -> list[str]:
        """Parts that no piece reaches across; together the whole text."""
        normal = (MARK if self.prefix else "") + normal.replace(" ", MARK) if normal else ""
        if not normal or not self.cuts:
            return [normal] if normal else []
        pattern = _LINE_PARTS if self.line_cuts else _PARTS
        return pattern.findall(normal)

    def _encode(self, parts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids as bytes, equal to the sentencepiece library's) of each part."""
        return [c[:2] for c in self._coded(parts)]

    def _coded(self, parts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids as bytes, equal to the sentencepiece library's, given back by the decoder) of each part."""
        got = [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
        want = self._by_reference(parts)
        back = self._given_back(parts, got)
        return [(np.asarray(g, dtype="<u4").tobytes(), g == w, b) for g, w, b in zip(got, want, back)]

    def _given_back(self, parts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the library's decoder gives each part back; parts are decoded together, and
        one by one only where the text of many is another."""
        starts = range(0, len(parts), TOGETHER)
        joined = self.tokenizer.decode_batch([list(chain.from_iterable(ids[k:k + TOGETHER])) for k in starts], skip_special_tokens=False)
        out: list[bool] = []
        for k, text in zip(starts, joined):
            some = range(k, min(k + TOGETHER, len(parts)))
            fine = text == self._shown("".join(parts[k:k + TOGETHER]))
            out += [True] * len(some) if fine else [
                t == self._shown(parts[i]) for i, t in zip(some, self.tokenizer.decode_batch([ids[i] for i in some], skip_special_tokens=False))]
        return out

    def _shown(self, part: str) -> str:
        """The text of a part as decoded alone: one leading blank is taken for the dummy prefix."""
        text = part.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _by_reference(self, parts: list[str]) -> list[list[int]]:
        """Ids by the sentencepiece library.  It adds a marker of its own in front, so a part
        that starts with one is given without it, any other (or only blanks) behind a line end."""
        spaced = [p.replace(MARK, " ") for p in parts]
        if not self.prefix or self.trims or not self.line_cuts:
            # The library can't be shown a part as it stands: the whole text is compared instead.
            return [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
        lead = len(self.reference.encode("\n"))
        bare = [p.startswith(" ") and p.strip(" ") != "" for p in spaced]
        ids = self.reference.encode([p[1:] if b else "\n" + p for p, b in zip(spaced, bare)], num_threads=1)
        return [i if b else i[lead:] for i, b in zip(ids, bare)]

    def encode(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, bool]]:
        """(normalised text, ids, parity) of each text."""
        return (x[:3] for x in self.checked(texts))

    def checked(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, bool, bool]]:
        """(normalised text, ids of the rebuilt model, parity, round trip) of each text.

        Parity says whether the sentencepiece library gives the same ids."""
        normal = [self.normal(t) for t in texts]
        cut = [self.parts(n) for n in normal]
        known = self.memo.lookup(set().union(*cut) if cut else ())
        whole = not self.line_cuts or not self.prefix or self.trims
        for text, n, parts in zip(texts, normal, cut):
            got = [known[p] for p in parts]
            ids, same = np.frombuffer(b"".join([g[0] for g in got]), dtype="<u4"), all([g[1] for g in got])
            if whole:
                same = bool(np.array_equal(ids, np.asarray(self.reference.encode(text), dtype="<u4")))
            # A marker of the text's own can't be told from a blank.
            yield n, ids, same, MARK not in n and all([g[2] for g in got])

    def decode_batch(self, found: list[np.ndarray]) -> list[str]:
        """Texts of many id lists by the library's decoder, in one multithreaded call."""
        plain = [self._silent(i) for i in found]
        out = self.tokenizer.decode_batch([[] if p is None else p for p in plain], skip_special_tokens=False)
        return [self.decode(i) if p is None else t for i, p, t in zip(found, plain, out)]

    def _silent(self, ids: np.ndarray) -> list[int] | None:
        """Ids without control pieces, which have no text; None if an unknown piece is among
        them, which the two libraries write differently."""
        kept = [i for i in np.asarray(ids).tolist() if self.bytes[i]]
        return None if self.unknown in kept else kept

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, markers as blanks, bytes put together."""
        table = self.bytes
        raw = b"".join([table[i] for i in ids.tolist()])
        return (raw[1:] if self.prefix and raw.startswith(b" ") else raw).decode("utf-8", "replace")


#: A marker run with the characters behind it; with line ends standing alone.
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LINE_PARTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_MODELS: dict[str, PieceModel] = {}


def _library_regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


def piece_model(path: str) -> PieceModel:
    """The model, loaded once per Python process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _encode_job(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # unless the cluster says otherwise
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        model = piece_model(path)
        for b in batches:
            rows = list(zip(*C.columns(b, "doc_id", "text")))
            for part in C.chunks_of(rows, lambda r: len(r[1]), 2_000_000):
                out = []
                for (doc_id, _), (_, ids, same, back) in zip(part, model.checked([t for _, t in part])):
                    out.append((doc_id, len(ids), zlib.crc32(ids.tobytes()), back, same, ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()),
                     pa.array([r[3] for r in out], pa.bool_()), pa.array([r[4] for r in out], pa.bool_())]
                    + ([pa.array([r[5].astype(np.int32) for r in out], pa.list_(pa.int32()))] if with_ids else []),
                    ["doc_id", "n_ids", "ids_crc32", "round_trip", "parity"] + ["ids"] * with_ids)
    return run


def encode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip, parity (and ``ids``) of each row."""
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids
    return C.texts(docs).mapInArrow(_encode_job(model_path, with_ids), schema)


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with ``ids`` (null ids: null text)."""
    def run(batches):
        model = piece_model(model_path)
        for b in batches:
            ids, found = C.columns(b, "doc_id", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
                [None if i is None else t for i, t in zip(found, model.decode_batch([np.asarray(i or [], dtype=np.int64) for i in found]))],
                pa.string())], ["doc_id", "text"])
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Ids of every document by the rebuilt model, with round trip and parity."""
    import public_tokenizers

    return encode(C.table(spark, sf_dir, "documents"), public_tokenizers.path(model), with_ids=False)
