import random

import pytest

from fieldlens.llm import edit_counts as E

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def whole(text):
    if not hasattr(whole, "tok"):
        from tokenizers import Tokenizer

        whole.tok = Tokenizer.from_file(PATH)
        whole.tok.encode_special_tokens = True
    return len(whole.tok.encode(text or "", add_special_tokens=False).ids)


BITS = ["word", " word", "  ", " ", "\n", "\n\n", "\t", "'s", "'", ".", "...", "é", " ", " ", "\x1c", "😀", "12", " 345", "<|endoftext|>", "ſ", "a" * 30, "\r\n"]


def test_parts_add_up():
    r, count = random.Random(9), E.counter(PATH)
    for _ in range(2000):
        text = "".join(r.choices(BITS, k=r.randrange(25)))
        parts = E.parts_of(text)
        assert "".join(parts) == text
        assert sum(count.counts(parts)) == whole(text), repr(text)


def test_edits_equal_full_counts():
    r, count = random.Random(10), E.counter(PATH)
    for _ in range(150):
        text = "".join(r.choices(BITS, k=r.randrange(400)))
        tree = E.Tree(text, *E.leaves_of(text, count))
        for _ in range(6):
            at, gone, put = r.randrange(len(text) + 3), r.choice([0, 0, 1, 3, 50, 5000]), "".join(r.choices(BITS, k=r.randrange(6)))
            start = min(at, len(text))
            text = text[:start] + put + text[min(len(text), start + gone):]
            tree.edit(at, gone, put, count)
            assert tree.text == text and tree.total == whole(text)
            assert sum(tree.leaf_sums()[0]) == len(text) and sum(tree.leaf_sums()[1]) == tree.total


def test_only_the_region_is_encoded_again():
    count, text = E.counter(PATH), "some plain words here " * 5000
    tree = E.Tree(text, *E.leaves_of(text, count))
    assert tree.edit(50_000, 5, "new", count) < 1000
    assert tree.edit(50_000, 0, "much more text " * 2000, count) == len(tree.text)  # the leaf has outgrown the tree
    assert tree.edit(50_000, 5, "new", count) < 1000 and tree.total == whole(tree.text)


def test_trees_and_edits_of_a_table(spark):
    rows = [(1, "One two three.", "x"), (1, "One two three.", "x"), (2, None, None), (3, "", None), (None, "null id here", None), (4, "long text " * 20_000, None)]
    trees = E.build_trees(spark.createDataFrame(rows, "doc_id long, text string, edits string"), PATH).collect()
    assert [t.n_tokens for t in trees] == [whole(r[1]) for r in rows]
    edits = [[(3, 0, " more"), (0, 1, "")], None, [(5, 9, "text")], [(0, 0, None), None], [(4, 2, None)], [(100, 3, "abc\n")]]
    made = spark.createDataFrame([(*t[:2], *t[3:], e) for t, e in zip(trees, edits)],
                                 f"doc_id long, text string, leaf_chars array<long>, leaf_tokens array<long>, edits {E.EDITS}")
    got = E.apply_edits(made, PATH).collect()
    assert [g.text for g in got][:5] == ["ne more two three.", "One two three.", "text", "", "nulld here"]
    assert [g.n_tokens for g in got] == [whole(g.text) for g in got]
    assert all(sum(g.leaf_tokens) == g.n_tokens and sum(g.leaf_chars) == g.n_chars == len(g.text) for g in got)
    assert E.apply_edits(made.limit(0), PATH).count() == 0 and E.build_trees(made.limit(0), PATH).count() == 0


def test_query_equals_brute_force(spark):
    from conftest import sf_dir
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir('0.001')}/documents.parquet")
    got = {r.doc_id: r for r in E.op4_edit_counts(spark, sf_dir("0.001")).collect()}
    for r in docs.select("doc_id", "text", E.derived_edits(F.col("text"), F.col("doc_id")).alias("edits")).collect():
        text = r.text
        for e in r.edits:
            text = text[:e["at"]] + (e["ins"] or "") + text[min(len(text), e["at"]) + e["del"]:]
        assert (got[r.doc_id].n_before, got[r.doc_id].n_tokens, got[r.doc_id].n_chars) == (whole(r.text), whole(text), len(text))
