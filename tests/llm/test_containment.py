import re

import pytest

from fieldlens.llm import containment as N

DOCS = "doc_id long, text string, item_id string, n_found string"
ITEMS = "item_id long, text string, doc_id string"


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(docs, items, threshold=0.8):
    out = []
    for d, t, *_ in docs:
        for i, b, *_ in items:
            k = min(5, len((b or "").split()))
            own = shingles(b, k)
            n = len(own & shingles(t, k))
            if own and n >= threshold * len(own) - 1e-9:
                out.append((d, i, n, len(own)))
    return sorted(out, key=str)


WORDS = [f"w{k}" for k in range(60)]
ITEM_ROWS = [(1, " ".join(WORDS[:30]), "a"), (2, " ".join(WORDS[30:36]), "a"), (3, "two words", None), (4, "", None), (5, None, None),
             (6, "Ünïted Grüße an  alle\nhier unten", None), (7, " ".join(WORDS[:30]), "same"), (8, "again " * 20, None), (9, "one", None)]
LONG = " ".join(f"x{k}" for k in range(40_000))
DOC_ROWS = [(1, LONG + " " + " ".join(WORDS[:30]) + " " + LONG, "z", "z"), (2, None, None, None), (3, "", None, None),
            (4, " ".join(WORDS[:27]), None, None), (5, " ".join(WORDS[:20]), None, None), (6, " ".join(WORDS[:14] + ["new"] + WORDS[15:30]), None, None),
            (7, "Here are TWO   Words\tand more", None, None), (8, "x ÜNÏTED grüße an alle hier unten y", None, None), (None, " ".join(WORDS), None, None),
            (9, " ".join(WORDS), None, None), (9, " ".join(WORDS), None, None), (10, "again again again again again", None, None), (11, "someone", None, None)]


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_equals_brute_force(spark, block_words):
    got = N.contained_items(spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS), block_words=block_words)
    assert sorted([tuple(g)[:4] for g in got.collect()], key=str) == brute(DOC_ROWS, ITEM_ROWS)


def test_documents_without_items(spark):
    docs = spark.createDataFrame(DOC_ROWS, DOCS)
    got = N.without_items(docs, spark.createDataFrame(ITEM_ROWS, ITEMS), block_words=20)
    leaked = {d for d, *_ in brute(DOC_ROWS, ITEM_ROWS)}
    assert got.schema == docs.schema
    assert sorted(g.doc_id for g in got.collect()) == sorted(d for d, *_ in DOC_ROWS if d not in leaked)


def test_sketches_meet_every_sufficient_subset():
    for n in range(1, 40):
        block = N.ItemBlock([(0, " ".join(f"v{k}" for k in range(n + 4)))], 5, 0.8)
        members = sum(len(keys) for _, keys, _ in block.lookup.values())
        least = -(-8 * n // 10)
        assert members + least > n  # no subset of that size misses the sketch


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert N.contained_items(docs.limit(0), items).count() == 0
    assert N.contained_items(docs, items.limit(0)).count() == 0
    assert N.without_items(docs, items.limit(0)).count() == len(DOC_ROWS)


def test_normal_text():
    for t in ("A  b\t c ", " x Y\x1cz", "É\r\n\x0b\x0cf", ""):
        assert N.normal(t) == " ".join(re.split(r"\s+", " ".join(t.lower().split()))).encode()
