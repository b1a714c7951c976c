"""Operator 13: quality rules, applied to lines before documents.

Every line with a word passes three groups of rules or is removed:

* punctuation: it ends in a sentence mark (quotes and brackets may follow), holds at most
  one symbol of ``[#*$%&|<>]`` and one run of ``!`` or ``?`` marks to five words, and is not
  written in capitals;
* navigation: it has at most one bar, bullet or arrow, and names no menu, log-in or script;
* boilerplate: it is no licence, rights or cookie notice and no filler text.

What is left is the cleaned text.  A document is kept if it passes the base rules (50 words,
at most half of them inside repeated three-word windows) and its removed lines hold at most
half of its word characters.

One pass over the documents, no shuffle: each task reads whole texts as UTF-8 bytes in
batches bounded by bytes, so its memory is bounded by its longest text.

Defined cases: a null text is empty, has no words and is not kept; blank lines count
nowhere and stay; a line counts as repeated if an earlier line of its text is equal to it
byte by byte, blanks included; a text of fewer than three words has no window; repeated rows
give repeated result rows; a null ``doc_id`` stays null; other columns, also those named
like a result, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Base rules: words at least, per cent of words in repeated windows at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Per cent of the word characters that removed lines may hold.
MOST_LOST = 50
#: Symbols, or runs of exclamation and question marks, to so many words.
WORDS_A_SYMBOL = 5

BLANKS = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = b"abcdefghijklmnopqrstuvwxyz"

# Patterns of the line rules, as RE2 reads them, too.
#: A sentence mark, then closing quotes or brackets, then blanks.
SENTENCE_END = r"""[.!?:;\x{2026}\x{3002}\x{ff01}\x{ff1f}]["')\]\x{bb}\x{201d}\x{2019}]*[\x20\x09-\x0D]*$"""
MARK_RUN = r"[!?][!?]+"
SEPARATORS = ["|", "\u00b7", "\u2022", "\u00bb", "\u2192", ">>"]
MENU = ["javascript", "sign in", "sign up", "log in", "login", "logout", "click here", "read more", "next page", "previous page",
        "back to top", "skip to", "site map", "sitemap", "share this", "subscribe", "breadcrumb"]
NOTICE = ["all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
          "cookie policy", "use of cookies", "uses cookies", "copyright (c)", "\u00a9", "lorem ipsum"]


def _end_pattern() -> re.Pattern:
    """SENTENCE_END for UTF-8 bytes: a class with longer characters becomes alternatives."""
    def klass(m: re.Match) -> str:
        chars = re.sub(r"\\x\{([0-9a-f]+)\}", lambda x: chr(int(x.group(1), 16)), m.group(1))
        wide = [c for c in chars if ord(c) > 127]
        return "(?:" + "|".join(["[" + "".join(c for c in chars if ord(c) < 128) + "]", *wide]) + ")" if wide else m.group(0)

    return re.compile(re.sub(r"\[((?:\\.|[^\]\\])+)\]", klass, SENTENCE_END).replace("$", r"\Z").encode())


_END, _MARKS = _end_pattern(), re.compile(MARK_RUN.encode())
_BARS = [s.encode() for s in SEPARATORS]
_PHRASES = [s.encode() for s in MENU + NOTICE]


class LineRules:
    """The rules that can fail a line of one text: what the text doesn't hold is not looked for."""

    def __init__(self, raw: bytes):
        low = raw.lower()
        self.phrases = [p for p in _PHRASES if p in low]
        self.bars = [s for s in _BARS if s in raw]
        self.symbols = len(raw) > len(raw.translate(None, SYMBOLS))
        self.marks = _MARKS.search(raw) is not None
        self.capitals = len(raw) - len(raw.translate(None, CAPITALS)) > 1

    def fails(self, line: bytes, n_words: int) -> bool:
        """Whether a line (with ``n_words`` >= 1 words) is to be removed."""
        if not _END.search(line, max(0, len(line) - 64)) and not _END.search(line):
            return True
        if self.symbols and WORDS_A_SYMBOL * (len(line) - len(line.translate(None, SYMBOLS))) > n_words:
            return True
        if self.capitals and n_words > 1 and len(line.translate(None, SMALL)) > len(line.translate(None, CAPITALS)):
            return True  # more capitals than small letters
        if self.marks and WORDS_A_SYMBOL * len(_MARKS.findall(line)) > n_words:
            return True
        if self.bars and sum(map(line.count, self.bars)) > 1:
            return True
        if self.phrases:
            low = line.lower()
            return any(p in low for p in self.phrases)
        return False


def _chars(raw: bytes) -> int:
    """Code points that are no blanks."""
    return len(raw.translate(None, BLANKS + CONTINUATION))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand twice or more in the text."""
    if len(words) < 4:
        return 0
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n = len(known)
    if n == len(words):
        return 0
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # three ids do not fit into 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    found = np.flatnonzero(times[which] > 1)
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[found + k] = True
    return int(inside.sum())


def measure(raw: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines,
    removed_chars of a text, and its text without the failing lines."""
    words = raw.split()
    lines = raw.split(b"\n")
    seen, kept, rules = set(), [], LineRules(raw)
    n_lines = removed = lost = 0
    for line in lines:
        n = len(line.split())
        if n:
            n_lines += 1
            seen.add(line)
            if rules.fails(line, n):
                removed += 1
                lost += _chars(line)
                continue
        kept.append(line)
    return (len(words), _chars(raw), len(raw) - len(raw.translate(None, SYMBOLS)), n_lines - len(seen),
            repeated_words(words), n_lines, removed, lost, b"\n".join(kept))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines", "removed_chars"]
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean"


def _job(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            rows = [measure(t) for t in texts]
            got = {m: [r[i] for r in rows] for i, m in enumerate(MEASURES)}
            base = [w < LEAST_WORDS or 100 * r > MOST_REPEATED * w for w, r in zip(got["n_words"], got["n_repeat_words"])]
            out = {"doc_id": b.column(0)} | {m: pa.array(v, pa.int64()) for m, v in got.items()}
            out["base_failed"] = pa.array(base, pa.bool_())
            out["kept"] = pa.array([not f and 100 * lost <= MOST_LOST * all_ for f, lost, all_ in
                                    zip(base, got["removed_chars"], got["word_chars"])], pa.bool_())
            if with_text:
                out["cleaned"] = pa.array([r[-1] for r in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)
    return run


def clean_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Measures, verdict and (``with_text``) cleaned text of every document."""
    C.small_batches(docs.sparkSession)
    return C.texts(docs).mapInArrow(_job(with_text), SCHEMA + (", cleaned string" if with_text else ""))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document of ``documents``."""
    return clean_lines(C.table(spark, sf_dir, "documents"), with_text=False)


_LINE_CHARS = r"length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _bars_sql() -> str:
    """Separators in a line; ``>>`` counts without overlaps."""
    return " + ".join(f"(length(l) - length(replace(l, {_sql(s)}, ''))) // {len(s)}" for s in SEPARATORS)


def _phrases_sql() -> str:
    small = "translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return "(" + " OR ".join(f"contains({small}, {_sql(p)})" for p in MENU + NOTICE) + ")"


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
inside AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, l, len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (SELECT r, l, {_LINE_CHARS} AS chars,
    NOT regexp_matches(l, {_sql(SENTENCE_END)})
    OR {WORDS_A_SYMBOL} * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > n
    OR (n > 1 AND length(regexp_replace(l, '[^A-Z]', '', 'g')) > length(regexp_replace(l, '[^a-z]', '', 'g')))
    OR {WORDS_A_SYMBOL} * len(regexp_extract_all(l, {_sql(MARK_RUN)})) > n
    OR {_bars_sql()} > 1
    OR {_phrases_sql()} AS fails
  FROM lines WHERE n > 0),
by_doc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (fails) AS n_removed_lines,
    coalesce(sum(chars) FILTER (fails), 0) AS removed_chars FROM judged GROUP BY r),
m AS (SELECT w.doc_id, len(w.ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(inside.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
    coalesce(removed_chars, 0) AS removed_chars
  FROM w LEFT JOIN inside USING (r) LEFT JOIN by_doc USING (r))
SELECT doc_id, {', '.join(f'CAST({m} AS BIGINT) AS {m}' for m in MEASURES)},
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
    AND 100 * removed_chars <= {MOST_LOST} * word_chars AS kept
FROM m
"""
