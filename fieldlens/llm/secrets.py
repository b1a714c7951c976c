"""Operator 1: secret scan by dictionary-primed zstandard novelty.

Base findings are the strings of three fixed patterns.  The method adds strings that
stand in a sensitive context (behind a word such as key, auth, credential) and that
cannot be compressed: a candidate's novelty is the number of bytes by which the
compressed context grows when the candidate is appended, per byte of the candidate.  The
compressor is primed with an identifier dictionary, so ordinary words, names and paths
cost next to nothing, while random keys cost most of their length.

The dictionary holds the identifiers of the whole corpus that save the most bytes
(occurrences times length), counted over all documents by a partial aggregate; only the
dictionary, of bounded size, reaches the driver and the workers.  Strings long enough to be
candidates, and their parts, are not counted, so no number of copies makes a secret cheap.
For the same reason a finding is one at all its candidate places in a document.

A sensitive word is a word or a part of a name (``auth`` in authToken and auth_token, not
in author); it stands before a candidate or, without a line break between, right behind it
("KEY is the private key").  A candidate on the line after a finding continues it, as the
lines of a private key do.

Defined cases: a null text is empty and has no findings; a novel span never overlaps a
base span; repeated rows give repeated rows; an empty table has an empty dictionary and
result; offsets are code points, ends exclusive; other columns are ignored.  A text is gone
through once, whatever its length and the number of its findings.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# Fixed patterns and least lengths of the base kinds, in their order.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: ``HEX`` matches of the least length alone; shorter ones fail anyway.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Words that make a context sensitive, at most this many characters before a candidate.
_LONG = "secret|passw(?:or)?d|passphrase|credential|private|bearer|token|signature|signing|session|cookie|encrypt(?:ion|ed)?|license"
_SHORT = "pwd|auth(?:orization|entication)?|api|access|key"
#: Short words begin a word or a part of a name; all end one (a plural, an id).
SENSITIVE = re.compile(
    rf"(?:{_LONG}|(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:{_SHORT}))(?:{_LONG}|{_SHORT})*+(?:s|id)?+(?:(?![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))", re.I | re.A)
CONTEXT = 48
#: What says behind a candidate what it is.
BEHIND = re.compile(r"[\"'`]?[\x20,;)]{0,2}(?:is|was|as|for|=|\()\x20(?:(?:the|my|our|your|a|an)\x20)?(?:[A-Za-z]+[\x20_-]){0,2}", re.A)
#: The break between two lines of one secret.
NEXT_LINE = re.compile(r"[\x20\t]*(?:\\n|\r?\n)[\x20\t]*")
LEAST_NOVEL = 16
#: Strings of the least length, each looked at once from its start.  An assignment sign
#: ends one; signs that nothing follows are padding.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.~-])(?:[A-Za-z0-9+/_.~-]{%d,}+(?:=++(?![A-Za-z0-9+/_.~-]))?+|[A-Za-z0-9+/_.~-]++=++(?![A-Za-z0-9+/_.~-]))" % LEAST_NOVEL)
#: What stands before an assignment sign and is a name: it has a sensitive word itself or no digit.
ASSIGNED = re.compile(r"=++[A-Za-z0-9+/_.~-]")
NAME = re.compile(r"[^0-9]*+$")
#: Least compressed bytes per byte: random hexadecimal text needs about 0.5, base64 0.75.
NOVELTY = 0.45
#: Strings that the dictionary leaves out: as long as a candidate.
LONG = r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{%d,}+" % LEAST_NOVEL
DICTIONARY_BYTES = 64 * 1024


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """Identifiers of 4 characters or more in at least two places, the most useful last;
    none of a string that is long enough to be a candidate."""
    spark, most = docs.sparkSession, size // 5
    short = F.regexp_replace("text", LONG, " ")
    words = C.texts(docs).select(F.explode(F.split(short, "[^A-Za-z0-9_]+")).alias("w")).where("length(w) >= 4")
    counts = words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    counts = C.cut(spark, counts.withColumn("saves", F.col("n") * F.length("w")), "op1-words")
    # Levels of what a word saves, about a thousand; the words above the level at which enough
    # are found go to the driver, not the best of every partition.
    levels = {r.level: r.k for r in counts.groupBy(F.floor(16 * F.log2("saves")).alias("level")).agg(F.count("*").alias("k")).collect()}
    least, found = 0, 0
    for level in sorted(levels, reverse=True):
        least, found = level, found + levels[level]
        if found >= most:
            break
    best = counts.where(F.floor(16 * F.log2("saves")) >= least).orderBy(F.desc("saves"), "w").limit(most).collect()
    C.drop(spark, counts)
    out, total = [], 0
    for r in best:
        total += len(r.w) + 1
        if total > size:
            break
        out.append(r.w)
    return " ".join(reversed(out)).encode()


class NoveltyMeter:
    """Marginal compressed bytes of a string behind a context."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        if primed:
            primed.precompute_compress(level=9)
        self.press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False) \
            if primed else zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False)

    def marginal(self, before: str, found: str) -> int:
        head, tail = before.encode("utf-8", "replace"), found.encode("utf-8", "replace")
        return len(self.press.compress(head + tail)) - len(self.press.compress(head))

    def novelty(self, before: str, found: str) -> float:
        return self.marginal(before, found) / max(1, len(found.encode("utf-8", "replace")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def _sensitive(text: str, s: int, e: int) -> bool:
    """Whether the context of the string at s to e is sensitive."""
    if SENSITIVE.search(text, max(0, s - CONTEXT), s):
        return True
    m = BEHIND.match(text, e)
    return bool(m) and any(SENSITIVE.match(text, k) for k in range(m.start() + 1, m.end() + 1) if not text[k - 1].isalpha())


def novel_spans(text: str, base: list[tuple[int, int, int]], meter: NoveltyMeter, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings in a sensitive context (the name they are assigned to included)."""
    out, known = [], set()
    at, reach = 0, 0  # base spans that begin before the candidate's end, and where they end at last
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if e - s < LEAST_NOVEL or reach > s:
            continue
        if ((out and s - out[-1][2] <= CONTEXT and NEXT_LINE.fullmatch(text, out[-1][2], s)) or _sensitive(text, s, e)) \
                and not (ASSIGNED.match(text, e) and (SENSITIVE.search(text, s, e) or NAME.match(text[s:e]))) \
                and (text[s:e] in known or meter.novelty(text[max(0, s - 4 * CONTEXT):s], text[s:e]) >= least):
            out.append((s, 3, e))
            known.add(text[s:e])
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_spans(text: str, meter: NoveltyMeter) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, meter))


def _meters(dictionary: bytes) -> NoveltyMeter:
    key = hashlib.sha256(dictionary).digest()
    if key not in _METERS:
        _METERS.clear()
        _METERS[key] = NoveltyMeter(dictionary)
    return _METERS[key]


_METERS: dict[bytes, NoveltyMeter] = {}


def scan(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind,start,end,novelty>> of each row, base and novel;
    only novel ones have a novelty."""
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(identifier_dictionary(docs) if dictionary is None else dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _meters(shared.value)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
        for b in batches:
            ids, found = C.columns(b, "doc_id", "text")
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "novelty": meter.novelty(t[max(0, s - 4 * CONTEXT):s], t[s:e]) if k == 3 else None}
                     for s, k, e in find_spans(t, meter)[1]] for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    return C.texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>")


def redact(docs: DataFrame, dictionary: bytes | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs``, all rows and columns, with every finding of ``text`` masked (for an
    assignment only its value); ``n_chars``, where there is one, follows the text."""
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(identifier_dictionary(docs) if dictionary is None else dictionary)
    schema = docs.schema

    def clean(text: str | None, meter: NoveltyMeter) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, k, e in find_spans(text, meter)[1]:
            if k == 0:
                s = ASSIGN.match(text, s).start(2)
            if e <= at:
                continue
            out += [text[at:max(at, s)], mask if s >= at else ""]
            at = e
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _meters(shared.value)
        for b in batches:
            at = b.schema.get_field_index("text")
            old = b.column(at).to_pylist()
            new = [clean(t, meter) for t in old]
            arrays = list(b.columns)
            arrays[at] = pa.array(new, b.schema.field(at).type)
            if (n := b.schema.get_field_index("n_chars")) >= 0:
                counts = arrays[n].to_pylist()
                arrays[n] = pa.array([c if x is y or x == y else len(y) for c, x, y in zip(counts, old, new)], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, schema)


def op1_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, all spans."""
    found = scan(C.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(base), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"), count("novel"))
