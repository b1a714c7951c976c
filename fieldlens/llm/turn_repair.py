"""Operator 11: repair of conversation structure by depth-first branch and bound.

A conversation is well formed if its role initials read ``(s?(ua)+)?``.  A repair walks over
its rows in order and, before each row and at the end, may insert an empty text of user or
assistant (I, 3), keep the row (K, 0), make it user or assistant (R, 3) or delete it (D, 4).
Blank and repeated rows must go; a truncated row that stays costs 3 more.  Wanted is the
cheapest repair; among equals the one whose letters come first in ASCII.

The search is depth first with an explicit stack.  A node is (rows done, last initial).  Each
carries its cost so far and the letters on the path.  It is dropped if

* its cost and a lower bound of the remaining rows exceed the incumbent's cost, or equal it
  while its letters already come after the incumbent's, or
* the dominance table of its node holds a prefix of less cost, or of equal cost and earlier
  letters (two prefixes of one node and cost never continue each other, so the earlier one
  stays earlier whatever follows).

The bounds come from the rows' suffixes, back to front, with the order of equal costs left
out.  They are tight, so the first dive ends in a cheapest repair, and the rest of the search
only visits prefixes that could tie with it and come earlier: work and memory stay
proportional to the rows (their flags and bounds, never their texts).  When the stack is empty, optimality is proved.

Two jobs.  The first moves narrow rows only (no text: initial, faults, a digest): they are
clustered by conversation, repeated (role, text) pairs are numbered by a window that spills,
and one ordered stream of rows is solved conversation by conversation.  The second clusters
the texts with the answers and streams each conversation through the hash, so no text is ever
held.  A conversation's letters and hash are one value over all its rows in order, so one task
writes them, however long it is; nothing else is held of it.

Defined cases: a null role or text is one blank, a null ``conv_id`` is a conversation of its
own, null ``turn``s come first; rows of one turn are ordered by role, then by the SHA-256 of
their text; an unknown role can only be made user or assistant, or deleted (one whose first
character is s, u or a counts by it); an empty role has no initial and can't be kept; a
conversation without rows has the empty repair; gaps beyond the range of a long are cut to it;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Never a cost.
NO = 1 << 60
#: States: nothing put out yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> state after one more user or assistant turn.
TURN = (USER, USER, ASSISTANT, USER)
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
LONG_MAX = 2 ** 63 - 1


def _kept(state: int, initial: int) -> bool:
    """Whether a row of that initial may follow in that state."""
    return initial == SYSTEM and state == START or initial in (USER, ASSISTANT) and TURN[state] == initial


def suffix_bounds(rows: list[tuple[int, bool, bool]]) -> list[tuple[int, int, int, int]]:
    """For each number of rows done and each state, a lower bound of what the rest costs."""
    bound = [(0, NO, NO, 0)] * (len(rows) + 1)
    bound[-1] = _with_inserts([0, NO, NO, 0])
    for i in range(len(rows) - 1, -1, -1):
        initial, must_go, cut = rows[i]
        after, extra = bound[i + 1], TRUNCATED if cut else 0
        best = [a + DELETE for a in after]
        if not must_go:
            for s in range(4):
                best[s] = min(best[s], after[TURN[s]] + REROLE + extra)
                if _kept(s, initial):
                    best[s] = min(best[s], after[initial] + KEEP + extra)
        bound[i] = _with_inserts(best)
    return bound


def _with_inserts(best: list[int]) -> tuple[int, int, int, int]:
    user, assistant = min(best[USER], best[ASSISTANT] + INSERT), min(best[ASSISTANT], best[USER] + INSERT)
    return min(best[START], user + INSERT), min(best[SYSTEM], user + INSERT), user, assistant


def repair(rows: list[tuple[int, bool, bool]]) -> tuple[int, str]:
    """Least cost and first letters of a repair of (initial, must go, truncated) rows.

    ``initial`` is a state (SYSTEM, USER, ASSISTANT) or 0 for an unknown role."""
    n, bound = len(rows), suffix_bounds(rows)
    best_cost, best, first = NO, b"", None
    # Node -> cost, depth and letters of its best prefix so far (None: those of the first dive).
    dominance: dict[int, tuple[int, int, bytes | None]] = {}
    path = bytearray()
    # (rows done, state, cost, depth, letter): the letter leads into the node.
    stack: list[tuple[int, int, int, int, int]] = [(0, START, 0, 0, 0)]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        del path[max(0, depth - 1):]
        if letter:
            path.append(letter)
        least = cost + bound[i][state]
        if least > best_cost or least == best_cost and path >= best[:depth]:
            continue
        known = dominance.get(4 * i + state)
        if known is not None and (known[0] < cost or known[0] == cost and path >= (first[:known[1]] if known[2] is None else known[2])):
            continue
        dominance[4 * i + state] = (cost, depth, None if first is None else bytes(path))
        if i == n and state in (START, ASSISTANT):
            best_cost, best = cost, bytes(path)
            first = best if first is None else first
            continue  # more insertions would only cost more
        moves = [(cost + INSERT, b"I"[0], i, TURN[state])]
        if i < n:
            initial, must_go, cut = rows[i]
            extra = TRUNCATED if cut else 0
            moves.append((cost + DELETE, b"D"[0], i + 1, state))
            if not must_go:
                if _kept(state, initial):
                    moves.append((cost + KEEP + extra, b"K"[0], i + 1, initial))
                moves.append((cost + REROLE + extra, b"R"[0], i + 1, TURN[state]))
        # The least bound first, equal ones by letter; the stack takes them from behind.
        moves.sort(key=lambda m: (m[0] + bound[m[2]][m[3]], m[1]), reverse=True)
        stack.extend((j, s, c, depth + 1, x) for c, x, j, s in moves if c + bound[j][s] <= best_cost)
    return best_cost, best.decode()


def apply_repair(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The (role, text) rows after the edits ``audit``, one at a time."""
    state, source = START, iter(rows)
    for letter in audit:
        if letter == "I":
            state = TURN[state]
            yield ROLE[state], ""
            continue
        role, text = next(source)
        if letter == "K":
            state = INITIAL[role[:1]]
            yield role, text
        elif letter == "R":
            state = TURN[state]
            yield ROLE[state], text


# --- Spark -------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped, 2: repeated) of every row, damaged by
    the CRC-32 of its key."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                                F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank))) % 20
    return rows.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _ordered(*last: Column) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), *last, F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _narrow(rows: DataFrame) -> DataFrame:
    """Everything about ``rows`` (as of ``damage``) but the texts, clustered by conversation
    and in order; ``again``: the row's role and text stood in an earlier row."""
    bare = F.rtrim("text", F.lit(BLANKS))
    narrow = rows.select("conv_id", "turn", "role", "copies", F.substring("role", 1, 1).alias("initial"),
                         (F.length(bare) == 0).alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
                         F.unhex(F.sha2("text", 256)).alias("digest"))
    # Dropped rows come last in the window: they are in no conversation, and earlier than none.
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy((F.col("copies") == 0), F.col("turn").asc_nulls_first())
    return narrow.repartition("conv_id").withColumn("again", F.row_number().over(seen) > 1) \
        .select("conv_id", "turn", "role", "digest", "copies", "initial", "blank", "cut", "again").sortWithinPartitions(*_ordered())


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(conv_id, rows) of consecutive rows; ``rows`` is read on from the stream, never held."""
    from itertools import groupby

    stream = (r for b in batches for r in zip(*C.columns(b, "conv_id", *names)))
    for key, group in groupby(stream, key=lambda r: r[0]):
        yield key, group


#: Conversations, or letters of their repairs, in one result batch.
OUT_ROWS, OUT_LETTERS = 2000, 4 << 20


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, letters = [], 0
    for r in rows:
        out.append(r)
        letters += len(r["audit"])
        if len(out) >= OUT_ROWS or letters >= OUT_LETTERS:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, letters = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SOLVED = "conv_id long, " + ", ".join(f"{f} long" for f in FIGURES) + ", audit string"
_SOLVED = pa.schema([("conv_id", pa.int64())] + [(f, pa.int64()) for f in FIGURES] + [("audit", pa.string())])


def _solve_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def solve(key, group) -> dict:
        got = dict.fromkeys(FIGURES, 0)
        rows, least, most, distinct, before = [], None, None, 0, None
        for _, turn, copies, initial, blank, cut, again in group:
            for k in range(copies):
                duplicate = not blank and (again or k > 0)
                truncated = not blank and not duplicate and cut
                got["blank"] += blank
                got["duplicate"] += duplicate
                got["truncated"] += truncated
                got["illegal"] += bool(rows) and (before, initial) not in legal
                rows.append((INITIAL.get(initial, START), blank or duplicate, truncated))
                before = initial
            if copies and turn is not None:
                distinct += turn != most
                least, most = turn if least is None else least, turn
        got["gaps"] = 0 if least is None else min(LONG_MAX, most - least + 1 - distinct)
        got["cost"], got["audit"] = repair(rows)
        return {"conv_id": key, **got}

    yield from _batched((solve(*g) for g in _groups(batches, "turn", "copies", "initial", "blank", "cut", "again")), _SOLVED)


RESULT = SOLVED + ", repaired_sha256 string"


def _hash_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answer of each conversation comes first, then its rows in order."""
    def digest(key, group) -> dict:
        answer = next(group)
        rows = ((r[1], r[2]) for r in group for _ in range(r[3]))
        sha, first = hashlib.sha256(), True
        for role, text in apply_repair(rows, answer[4]):
            sha.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode("utf-8", "replace"))
            first = False
        for _ in group:  # rows that were deleted behind the last letter are none
            raise AssertionError("a row has no edit")
        return {"conv_id": key, **dict(zip(FIGURES, answer[5:])), "audit": answer[4], "repaired_sha256": sha.hexdigest()}

    yield from _batched((digest(*g) for g in _groups(batches, "role", "text", "copies", "audit", *FIGURES)),
                        _SOLVED.append(pa.field("repaired_sha256", pa.string())))


def _with_answers(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's answer, then its undropped rows in order, in one partition."""
    none = {f: F.lit(None).cast("long").alias(f) for f in FIGURES}
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("row"), "turn", "role", "text", "copies",
                                            F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(None).cast("string").alias("audit"), *none.values())
    answers = solved.select("conv_id", F.lit(0).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                            F.lit("").alias("text"), F.lit(0).alias("copies"), F.lit(None).cast("binary").alias("digest"), "audit", *FIGURES)
    return answers.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_ordered(F.col("row").asc()))


def repair_all(rows: DataFrame) -> DataFrame:
    """The figures, the repair and the hash of the repaired rows of every conversation of
    ``rows`` (conv_id, turn, role, text, copies)."""
    spark = rows.sparkSession
    C.small_batches(spark)
    solved = C.cut(spark, _narrow(rows).mapInArrow(_solve_job, SOLVED), "op11-solved")
    return _with_answers(rows, solved).mapInArrow(_hash_job, RESULT)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, position, role and text of every row after its conversation's repair."""
    spark = rows.sparkSession
    C.small_batches(spark)
    solved = C.cut(spark, _narrow(rows).mapInArrow(_solve_job, SOLVED), "op11-solved")
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of():
            for key, group in _groups(batches, "role", "text", "copies", "audit"):
                audit = next(group)[4]
                source = ((r[1], r[2]) for r in group for _ in range(r[3]))
                for k, (role, text) in enumerate(apply_repair(source, audit)):
                    yield {"conv_id": key, "position": k, "role": role, "text": text}

        for part in C.chunks_of(rows_of(), lambda r: 64 + len(r["text"]), C.BATCH_BYTES // 4):
            yield pa.RecordBatch.from_pylist(part, schema=schema)

    return _with_answers(rows, solved).mapInArrow(job, "conv_id long, position long, role string, text string")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage to, and repair of, every conversation of ``conversations``."""
    return repair_all(damage(C.table(spark, sf_dir, "conversations")))


def _op11_sql() -> str:
    """Costs and letters as one text (nine digits, then letters), so that the least text is the
    cheapest repair with the first letters; suffixes back to front."""
    def then(x: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({x}, 10)"

    def inserts(b0: str, b1: str, b2: str, b3: str) -> str:
        u, a = f"least({b2}, {then(b3, '3', 'I')})", f"least({b3}, {then(b2, '3', 'I')})"
        return f"least({b0}, {then(u, '3', 'I')}) AS x0, least({b1}, {then(u, '3', 'I')}) AS x1, {u} AS x2, {a} AS x3"

    def state(s: int) -> str:
        turn = TURN[s]
        kept = {START: "ini IN ('s', 'u')", SYSTEM: "ini = 'u'", USER: "ini = 'a'", ASSISTANT: "ini = 'u'"}[s]
        target = "CASE WHEN ini = 's' THEN x1 ELSE x2 END" if s == START else f"x{turn}"
        return (f"least({then(f'x{s}', '4', 'D')}, CASE WHEN NOT gone THEN {then(f'x{turn}', '3 + extra', 'R')} END, "
                f"CASE WHEN NOT gone AND {kept} THEN {then(f'({target})', 'extra', 'K')} END) AS y{s}")

    return rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
raw AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT conv, conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''),
    lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS kind FROM raw, tab),
convs AS (SELECT DISTINCT conv, conv_id FROM raw),
dam AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN CAST([] AS INT[]) WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit),
pos AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS p FROM dam),
fault AS (SELECT *, substr(role, 1, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY p) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY p) AS before FROM pos),
flat AS (SELECT conv, turn, role, text, p, ini, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS trunc,
    p > 1 AND before || ini NOT IN ('su', 'ua', 'au') AS illegal FROM fault),
figures AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (illegal) AS illegal FROM flat GROUP BY conv),
step AS (
  SELECT conv, count(p) AS i, {inserts("'000000000'", "'900000000'", "'900000000'", "'000000000'")}
  FROM convs LEFT JOIN flat USING (conv) GROUP BY conv
  UNION ALL
  SELECT conv, i, {inserts("y0", "y1", "y2", "y3")} FROM (
    SELECT step.conv, i - 1 AS i, blank OR dup AS gone, CASE WHEN trunc THEN 3 ELSE 0 END AS extra, {", ".join(map(state, range(4)))}
    FROM step JOIN flat ON flat.conv = step.conv AND flat.p = step.i)),
best AS (SELECT conv, CAST(substr(x0, 1, 9) AS BIGINT) AS cost, substr(x0, 10) AS audit FROM step WHERE i = 0),
letters AS (SELECT conv, audit, j, audit[j] AS letter, length(regexp_replace(audit[1:j], 'I', '', 'g')) AS p,
    length(regexp_replace(audit[1:j], 'D', '', 'g')) AS q FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)),
put AS (SELECT l.conv, l.j, l.letter, l.q, r.role, r.text, max(CASE WHEN l.q = 1 AND l.letter = 'K' AND r.ini = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY l.conv) AS s FROM letters l LEFT JOIN flat r ON r.conv = l.conv AND r.p = l.p),
hashes AS (SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS repaired_sha256 FROM put WHERE letter <> 'D' GROUP BY conv)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM convs LEFT JOIN figures USING (conv) LEFT JOIN best USING (conv) LEFT JOIN hashes USING (conv)
"""


OP11_SQL = _op11_sql()
