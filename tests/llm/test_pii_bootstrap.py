import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from fieldlens.llm import pii_bootstrap as B


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [None, "", "no data", "a@b.cc", "a@b.c_d@e.f", "a@b.c@d.e", "x.y+z@sub-1.example.org.", "@b.c a@b", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 010.000.0.0255",
         "4111 1111 1111 1111", "4111-1111-1111-1112", "12 4111111111111111", "+1 (555) 123-4567", "+1 555", "+123456789012345", "+1234567890123456 +1..........9",
         "é😀 a@b.cc 😀 9.9.9.9 é", "1" * 30_000, "a" * 30_000, ("9 " * 20_000), "a.b@" * 3000 + "c.d", "mail a@b.cc, phone +44 20 7946 0958; ip 10.0.0.1",
         ("x1@y.zz " * 2000), "00000000000000.1.1.1"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, base string, left string")


def test_base_spans_equal_brute_force(spark):
    r = random.Random(6)
    bits = ["a", "B", "0", "1", "25", "255", "4111", ".", ".", "@", "-", " ", "+", "+1", "(", ")", "_", "%", "é", "😀", "x.com", "1.1.1.1"]
    texts = TEXTS + ["".join(r.choices(bits, k=r.randrange(30))) for _ in range(1500)]
    got = B.extracted(frame(spark, texts)).select("doc_id", "base").collect()
    assert len(got) == len(texts)
    for g in got:
        assert [(s.start, s.kind, s.end) for s in g.base] == brute(texts[g.doc_id]), texts[g.doc_id]


def test_contexts_discover_unseen_forms(spark):
    texts = [f"reach me at mail{i}@host{i}.example.com today" for i in range(6)]
    texts += [f"member phone: +1 555 000 {1000 + i} ok" for i in range(8)]  # the pattern "phone:" leads to phones
    texts += ["member phone: 5550001 ok", "member phone: 555-7777 ok", "the year 2024 was fine", "version 12345 of 67890"]
    texts += ["noted 5550001 elsewhere"]  # the same instance without its context
    got = {r.doc_id: r for r in B.find(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    found = {i: [(texts[i][s.start:s.end], B.KINDS[s.kind]) for s in r.context] for i, r in got.items()}
    assert found[14] == [("5550001", "phone")] and found[15] == [("555-7777", "phone")]
    assert found[16] == [] and found[17] == [] and found[18] == [("5550001", "phone")]


def test_patterns_of_accepted_instances(spark):
    texts = [f"member phone: +1 555 000 {1000 + i} ok" for i in range(24)]
    texts += [f"member phone: 555000{i} ok" for i in range(4)]  # accepted in the first round
    texts += [f"please call 555000{i}" for i in range(4) for _ in range(3)]  # no seed stands behind "call"
    texts += ["please call 7770001", "order 7770002 came"]  # only learnt from the accepted ones
    got = {r.doc_id: [(texts[r.doc_id][s.start:s.end], B.KINDS[s.kind]) for s in r.context] for r in B.find(frame(spark, texts)).collect()}
    assert got[24] == [("5550000", "phone")] and got[28] == [("5550000", "phone")]
    assert got[40] == [("7770001", "phone")] and got[41] == []


def test_attached_contexts(spark):
    texts = [f"member tel:+15550001{100 + i} and" for i in range(12)]
    texts += ["home tel:5550001", 'the "number":"7770001" field', "see 8880001, then"]
    texts += [f"one, two, three {i}" for i in range(12)] + [f"from a{i}@b{i}.cc, to" for i in range(4)] + ["a free , sign"]
    got = {r.doc_id: [(texts[r.doc_id][s.start:s.end], B.KINDS[s.kind]) for s in r.context] for r in B.find(frame(spark, texts)).collect()}
    assert got[12] == [("5550001", "phone")]
    assert got[13] == [] and got[14] == []  # most commas stand behind other strings


def test_pattern_counts(spark):
    texts = ["tel:none tel:5550001 tel: x", "none, 5550001, done. (5)", "Tel:none"]
    got = {r.pattern: r.total for r in B.pattern_counts(frame(spark, texts)).collect()}
    assert (got["l:tel:"], got["r:,"], got["l:("], got["r:."], got["l:tel:none"]) == (4, 2, 1, 1, 2)


def test_unseen_forms_of_several_strings(spark):
    forms = ["555 123 4567", "0171 234567", "(555) 123-4567", "(030)1234567", "555.123.4567", "4111 1111 1111 1112"]
    texts = [f"member phone: +1 555 000 {1000 + i} ok" for i in range(40)] + [f"member phone: {f} ok" for f in forms]
    texts += ["member phone: 5550001 ok", "noted 5550001 2024 elsewhere", "in 12 34 abc", "version 555 123 of 4567x", "see (030)1234567."]
    got = {r.doc_id: [(texts[r.doc_id][s.start:s.end], B.KINDS[s.kind]) for s in r.context] for r in B.find(frame(spark, texts)).collect()}
    for i, form in enumerate(forms):
        assert got[40 + i] == [(form, "phone")]
    assert [got[i] for i in range(46, 51)] == [[("5550001", "phone")], [("5550001", "phone")], [], [], [("(030)1234567", "phone")]]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "ip 10.0.0.1", "x"), (1, "ip 10.0.0.1", "x"), (None, "ip 10.0.0.1", None), (None, None, None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = B.find(docs).collect()
    assert sorted((r.doc_id or -1, len(r.base)) for r in got) == [(-1, 0), (-1, 1), (1, 1), (1, 1), (2, 0)]
    assert B.find(docs.limit(0)).count() == 0


def test_query_digest_and_plan(spark):
    from conftest import sf_dir

    df = B.op2_pii_bootstrap(spark, sf_dir("0.001"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    got = {r.doc_id: r for r in df.collect()}
    for d in spark.read.parquet(f"{sf_dir('0.001')}/documents.parquet").collect():
        base = brute(d.text)
        line = ",".join(f"{B.KINDS[k]}:{s}:{e}" for s, k, e in base)
        g = got[d.doc_id]
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(line.split(",")) - {""} <= set(g.spans.split(","))


def test_spans_at_each_place_equal_a_plain_search(spark):
    r = random.Random(9)
    bits = ["a@b.cc", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "12", "x7", " ", " ", ", ", "+", "555 010", "+44 20 7946 0958.1.1.1"]
    texts = TEXTS + ["".join(r.choices(bits, k=r.randrange(60))) for _ in range(300)]
    t = frame(spark, texts).select("doc_id", B.base_spans(F.coalesce("text", F.lit(""))).alias("b"),
                                   F.expr("transform(sequence(0L, 400L, 7L), s -> struct(s as start, s + s % 31 + 1 as `end`))").alias("places"))
    got = t.select("b", "places", B._let(B._by_kind(F.col("b")), lambda k: F.transform("places", lambda p: B._overlapping(k, p))).alias("o")).collect()
    for g in got:
        for p, o in zip(g.places, g.o):
            assert [tuple(x) for x in o] == [tuple(x) for x in g.b if x.start < p.end and p.start < x.end]


def test_very_many_findings_in_one_text(spark):
    text = " ".join(f"m{i}@host{i}.example.com" for i in range(60_000))
    started = time.time()
    got = B.extracted(frame(spark, [text])).select(F.size("base").alias("n"), F.size("instances").alias("m")).first()
    assert (got.n, got.m) == (60_000, 60_000)
    assert time.time() - started < 60  # one pair of searches a place; all pairs would be 3.6 billion
