"""Operator 2: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base findings (e-mail, IP address, card and phone numbers) are fixed patterns with checks
and serve as seeds.  Every string with a digit or an at sign and every run of digit groups
("(555) 123-4567") is an instance, the words beside it are its lexical patterns ("left:
phone:", "right: extension").  A string inside such a run has no patterns of its own; it is
reported where it is known from elsewhere and the run is not accepted.  Instances and
patterns form a graph, which is pre-aggregated to its distinct edges and scored in rounds:

* a pattern's confidence in a kind is the share of all its occurrences in the corpus (free or
  attached to a string, whatever that is) that lead to a known instance of the kind; it also
  needs a least number of different known instances;
* an instance that is not known is accepted where the patterns around it make its kind
  likely enough (noisy or), and then is known wherever it occurs, which supports further
  patterns in the next round.

Accepted instances become spans ``ctx_<kind>``.  One pass over the texts extracts base
spans and instances, one counts words; after that no text travels.

Positions are code points.  A regular expression gives the strings and the text between
them, and two-level prefix sums over their lengths give the places, so texts with very many
matches stay in near-linear time.

Defined cases: a null text is empty; repeated rows give repeated rows with the same spans;
a null id is kept; contextual spans never overlap base spans; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base kinds.  The look-behinds and possessive loops change no match:
# they keep failing attempts from starting again inside a run (or from recursing).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Strings with a digit or an at sign.
INSTANCE = r"(?<![A-Za-z0-9@._+-])[A-Za-z._+-]*+[0-9@](?:[A-Za-z0-9@._+/-]*[A-Za-z0-9])?+"
#: Digit groups joined by single blanks, dots, hyphens, slashes or parentheses, over whole strings.
_GROUP = r"(?:\([0-9]++\)(?=[\x20./-]?[0-9])|[0-9]++)"
_STRING = _GROUP + r"(?:[./-]?" + _GROUP + r")*+(?![./()-]*+[A-Za-z0-9@_+])"
RUN = r"(?<![A-Za-z0-9@._+-])\+?" + _STRING + r"(?:\x20" + _STRING + r")*+"
#: Characters of the text beside an instance in which its neighbour words are sought.
NEAR = 64
#: Characters of a neighbour word that count, those next to the instance.
WORD = 48
#: Places inside a word where a string begins and ends, and the words beside these places.
BEGINS = r"(?s)(?<![A-Za-z0-9@._+-])(?=[A-Za-z0-9@._+(-])"
ENDS = r"(?s)(?<=[A-Za-z0-9])(?![@._+/-]*+[A-Za-z0-9])"
LEFT_LONG, LEFT_SHORT, RIGHT = BEGINS + f"(?<=(.{{{WORD}}}))", BEGINS + f"(?<=^(.{{1,{WORD - 1}}}))", ENDS + f"(?=(.{{1,{WORD}}}))"

ROUNDS = 3
CONFIDENCE = 0.8
SUPPORT = 3
#: An accepted instance has an at sign or this many digits.
LEAST_DIGITS = 4
BLOCK = 256
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda variable, not an expression)."""
    return F.transform(F.array(value), body)[0]


def _places(found: Column, gaps: Column) -> Column:
    """array<struct<start,end,text,before,after>> of the strings ``found`` between ``gaps``."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def slices(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / BLOCK).cast("int")),
                           lambda b: total(F.slice(w, b * BLOCK + 1, F.lit(BLOCK))))

    def starts(w: Column, sums: Column) -> Column:
        ahead = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        return _let(ahead, lambda p: F.transform(w, lambda _, i: p[F.floor(i / BLOCK).cast("int")] + total(
            F.slice(w, F.floor(i / BLOCK).cast("int") * BLOCK + 1, F.pmod(i, F.lit(BLOCK))))))

    def placed(f: Column, g: Column, s: Column) -> Column:
        return F.transform(f, lambda x, i: F.struct(
            (s[i] + F.length(g[i])).alias("start"), (s[i] + F.length(g[i]) + F.length(x)).alias("end"), x.alias("text"),
            F.substring(g[i], -NEAR, NEAR).alias("before"), F.substring(g[i + 1], 1, NEAR).alias("after")))

    steps = lambda f, g: F.transform(f, lambda x, i: (F.length(g[i]) + F.length(x)).cast("long"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>")
    return _let(found, lambda f: F.when(F.size(f) == 0, empty).otherwise(
        _let(gaps, lambda g: _let(steps(f, g), lambda w: _let(slices(w), lambda b: _let(starts(w, b), lambda s: placed(f, g, s)))))))


def places(text: Column, pattern: str, has: str) -> Column:
    """Leftmost non-overlapping matches of ``pattern``, only sought where ``has`` matches."""
    found = F.when(text.rlike(has), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return _places(found, F.split(text, pattern, -1))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def term(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _card_ok(found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    return _let(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of the base findings, by start and kind."""
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    kinds = [(EMAIL, "@", None), (IP, r"[0-9]\.[0-9]", lambda x: x.rlike(IP_VALID)), (CARD, "[0-9]", _card_ok),
             (PHONE, r"\+[0-9]", lambda x: digits(x).between(9, 15))]
    def of_kind(k: int, pattern: str, has: str, ok) -> Column:
        found = places(text, pattern, has)
        if ok:
            found = F.filter(found, lambda p: ok(p["text"]))
        return F.transform(found, lambda p: F.struct(p["start"], F.lit(k).alias("kind"), p["end"].alias("end"))).cast(SPAN)

    out = [of_kind(k, *rule) for k, rule in enumerate(kinds)]
    return F.array_sort(F.concat(*out))


def _by_kind(base: Column) -> Column:
    """The base spans of each kind that has any, and the step widths of a search in them."""
    spans = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.filter(base, lambda b: b["kind"] == k))
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    return F.transform(F.filter(spans, lambda a: F.size(a) > 0),
                       lambda a: F.struct(a.alias("spans"), F.filter(powers, lambda w: w <= F.size(a)).alias("widths")))


def _overlapping(kinds: Column, p: Column) -> Column:
    """The base spans that share a character with ``p``, by start and kind.

    Spans of one kind don't overlap, so both their starts and their ends ascend: two binary
    searches give those between, however many spans a text has."""
    def ahead(k: Column, before) -> Column:
        """How many spans of a kind, counted from the first, ``before`` holds for."""
        return F.aggregate(k["widths"], F.lit(0), lambda n, w: F.when(before(F.get(k["spans"], n + w - 1)), n + w).otherwise(n))

    def of_kind(k: Column) -> Column:
        return _let(ahead(k, lambda b: b["end"] <= p["start"]), lambda low: F.slice(
            k["spans"], low + 1, ahead(k, lambda b: b["start"] < p["end"]) - low))

    return F.array_sort(F.flatten(F.transform(kinds, of_kind)))


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, instances of every row: the one pass over the texts."""
    t = C.texts(docs)
    t = t.select("doc_id", "text", F.xxhash64("text").alias("text_key"), base_spans(F.col("text")).alias("base"),
                 places(F.col("text"), f"{RUN}|{INSTANCE}", "[0-9@]").alias("places"))
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    text = F.col("text")

    def strings(p: Column) -> Column:
        """The strings of a run, as places of the text."""
        inner = places(p["text"], INSTANCE, "[0-9]")
        return _let(inner, lambda q: F.transform(q, lambda x, i: F.struct(
            (p["start"] + x["start"]).alias("start"), (p["start"] + x["end"]).alias("end"), x["text"].alias("text"),
            F.when(i == 0, F.substring(F.concat(p["before"], x["before"]), -NEAR, NEAR)).otherwise(x["before"]).alias("before"),
            F.when(i == F.size(q) - 1, F.substring(F.concat(x["after"], p["after"]), 1, NEAR)).otherwise(x["after"]).alias("after"))))

    def one(p: Column, b: Column, run: Column = F.lit(None).cast("string")) -> Column:
        """The instance at a place; ``b``: base spans there.  One of several strings ("+1 555
        0100") is taken, with what stands behind it, from the text."""
        first = F.get(b, F.lit(0))
        longer = first["end"] > p["end"]
        whole = F.substring(text, (first["start"] + 1).cast("int"), (first["end"] - first["start"]).cast("int"))
        after = F.when(longer, F.substring(text, (first["end"] + 1).cast("int"), F.lit(NEAR))).otherwise(p["after"])
        return F.struct(p["start"], p["end"].alias("end"), F.when(longer, whole).otherwise(p["text"]).alias("instance"),
                        word(p["before"], rf"(\S{{1,{WORD}}})\s*$").alias("left"), word(after, rf"^\s*(\S{{1,{WORD}}})").alias("right"),
                        first["kind"].alias("kind"),
                        ((F.size(b) == 0) | F.exists(b, lambda x: x["start"] == p["start"])).alias("whole"), run.alias("run"))

    def instances(p: Column, b: Column, here) -> Column:
        """Those of a place.  A run in which base spans are is only its strings."""
        return F.when(~p["text"].rlike(r"[\x20(]"), F.array(one(p, b))) \
            .when(F.size(b) == 0, F.concat(F.array(one(p, b)), F.transform(strings(p), lambda q: one(q, b, p["text"])))) \
            .otherwise(F.transform(strings(p), lambda q: _let(here(q), lambda c: one(q, c))))

    # An instance is known where a base span starts with it; inside one it is left out.
    def made(kinds: Column) -> Column:
        here = lambda p: _overlapping(kinds, p)
        return F.flatten(F.transform("places", lambda p: _let(here(p), lambda b: instances(p, b, here))))

    made = _let(_by_kind(F.col("base")), made)
    return t.select("doc_id", "text_key", "base", F.filter(made, lambda p: p["whole"]).alias("instances"))


def _sides(edges: DataFrame) -> DataFrame:
    """One row a pattern of an edge: pattern, instance, known kind, occurrences."""
    return edges.select("instance", "kind", "n", F.explode(F.array(
        F.concat(F.lit("l:"), "left"), F.concat(F.lit("r:"), "right"))).alias("pattern")).where("length(pattern) > 2")


def pattern_counts(docs: DataFrame) -> DataFrame:
    """pattern, total: occurrences of every pattern, over all documents.

    Texts are cut at instances and blanks, as the words beside an instance are.  Such a word
    stands to the left and to the right of something; where other strings are in it ("tel:none"),
    what is before one stands to its left and what is behind it to its right, too.
    """
    words = C.texts(docs).select(F.explode(F.split(F.regexp_replace("text", INSTANCE, " "), r"\s+")).alias("word")).where("word <> ''")
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    beside = lambda pattern: F.filter(F.regexp_extract_all("word", F.lit(pattern), F.lit(1)), lambda x: x != "")
    named = lambda side, found: F.transform(found, lambda x: F.concat(F.lit(side), F.lower(x)))
    left = F.concat(F.array(F.substring("word", -WORD, WORD)), beside(LEFT_LONG), beside(LEFT_SHORT))
    right = F.concat(F.array(F.substring("word", 1, WORD)), beside(RIGHT))
    return words.select("n", F.explode(F.concat(named("l:", left), named("r:", right))).alias("pattern")) \
        .groupBy("pattern").agg(F.sum("n").alias("total"))


def learn(spark: SparkSession, seen: DataFrame, docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE,
          support: int = SUPPORT) -> DataFrame:
    """(instance, left, right, kind) of the edges that the rounds accept."""
    edges = seen.select(F.explode("instances").alias("i")).where("i.run IS NULL").groupBy("i.instance", "i.left", "i.right", "i.kind").agg(F.count("*").alias("n"))
    edges = C.cut(spark, edges, "op2-edges")
    # Word counts only matter for words beside as many instances, known or not, as support takes:
    # any of these may be accepted in a round and support the next one's patterns.
    beside = _sides(edges).groupBy("pattern").agg(F.count_distinct("instance").alias("known")).where(F.col("known") >= support)
    totals = C.cut(spark, beside.select("pattern").join(pattern_counts(docs), "pattern"), "op2-words")
    unknown = edges.where("kind IS NULL").select("instance", "left", "right").where(
        F.col("instance").contains("@") | (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= LEAST_DIGITS))
    known = edges.where("kind IS NOT NULL").groupBy("instance").agg(F.min("kind").alias("kind"))
    accepted, passed = None, [edges, totals]
    for _ in range(rounds):
        sides = _sides(edges.drop("kind").join(known, "instance"))
        scored = sides.groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.count_distinct("instance").alias("known")) \
            .where(F.col("known") >= support).join(totals, "pattern") \
            .select("pattern", "kind", F.least(F.lit(0.999), F.col("n") / F.greatest("total", "n")).alias("c")).where("c >= 0.2")
        scored = C.cut(spark, scored, "op2-patterns")
        both = _sides(unknown.withColumns({"kind": F.lit(None).cast("int"), "n": F.lit(1).cast("long")})).select("instance", "pattern").distinct()
        beliefs = both.join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("c"))))).alias("c"))
        best = beliefs.where(F.col("c") >= confidence).groupBy("instance").agg(F.max(F.struct("c", (-F.col("kind")).alias("k"))).alias("b")) \
            .select("instance", (-F.col("b.k")).alias("kind"))
        passed.append(scored)
        if accepted is not None:
            passed.append(accepted)
            best = accepted.unionByName(best).groupBy("instance").agg(F.min("kind").alias("kind"))
        accepted = C.cut(spark, best, "op2-accepted")
        known = edges.where("kind IS NOT NULL").select("instance", "kind").unionByName(accepted).groupBy("instance").agg(F.min("kind").alias("kind"))
    for table in passed:
        C.drop(spark, table)
    return accepted


def find(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """doc_id, base and context spans (array<struct<start,kind,end>>) of every row."""
    spark = docs.sparkSession
    seen = C.cut(spark, extracted(docs), "op2-seen")
    accepted = learn(spark, seen, docs, rounds, confidence, support)
    # Instances known nowhere by a base pattern but accepted by their contexts.
    at = seen.select("doc_id", "text_key", F.explode("instances").alias("i")).where("i.kind IS NULL") \
        .select("doc_id", "text_key", "i.start", "i.end", "i.instance", "i.run")
    # A string of a run stands for itself only where the run is not accepted.
    inside = at.where("run IS NOT NULL").join(accepted, "instance", "left_semi") \
        .join(accepted.select(F.col("instance").alias("run")), "run", "left_anti")
    at = at.where("run IS NULL").drop("run").unionByName(inside.drop("run"))
    context = at.join(accepted, "instance").groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).cast(SPAN).alias("context"))
    # Rows of one id and text have the same spans; null ids meet by a marker.
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("row_key")
    context = context.select(key("doc_id"), "text_key", "context")
    return seen.select("doc_id", "text_key", "base", key("doc_id")).join(context, ["row_key", "text_key"], "left") \
        .select("doc_id", "base", F.coalesce("context", F.array().cast(SPAN)).alias("context"))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, all spans."""
    found = find(C.table(spark, sf_dir, "documents"))
    name = lambda k, prefix: reduce(lambda a, i: a.when(k == i, prefix + KINDS[i]), range(1, 4), F.when(k == 0, prefix + KINDS[0]))
    lines = lambda spans, prefix: F.transform(spans, lambda s: F.struct(
        s["start"], s["kind"], F.concat_ws(":", name(s["kind"], prefix), s["start"].cast("string"), s["end"].cast("string")).alias("line")))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["line"]), ",")
    base = lines(F.col("base"), "")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    context = F.transform("context", lambda s: F.struct(s["start"], (s["kind"] + 4).alias("kind"), F.concat_ws(
        ":", name(s["kind"], "ctx_"), s["start"].cast("string"), s["end"].cast("string")).alias("line")))
    return found.select("doc_id", *[count(i) for i in range(4)], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.concat(base, context)).alias("spans"), F.size("context").cast("long").alias("n_context"))
