import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from fieldlens.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string, mask string, hash string"
LABELS = "doc_id long, quality int, toxic int, part string"


def rows(n=140, seed=5):
    """Documents with every combination of failures, copies within and across sources, nulls."""
    rng = random.Random(seed)
    base = [None, "", "A", "one two three", "same " * 250, " ".join(f"w{k}" for k in range(260)), " ".join(f"W{k}" for k in range(220)),
            " ".join(f"w{k}" for k in range(230)) + " $", "SAME " * 300 + "#", "é" * 49 + "A", "é" * 50 + "A", "\x0ba\x1cb c", "x" * 100_000]
    out = [(k, rng.choice(base), "en", rng.choice(["s1", "s2", None, ""]), "m", "h") for k in range(n)]
    out += [(500 + k, "copy of all", "en", "hot", "m", "h") for k in range(60)]
    return out + [out[3], out[3], (None, "copy of all", "en", "hot", "", ""), (7, "another text", None, "s1", None, None), (-1, base[4], "de", "s9", None, None)]


MARKS = [(k, k % 2, k % 3 == 0 and 1 or 0, "p") for k in range(0, 140, 2)] + [(2, 1, 1, "p"), (None, 1, 1, "p"), (4, None, None, None), (9_999, 1, 1, "p")]


def brute(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, _ in labels if x == 1 and i is not None}
    kinds = defaultdict(lambda: defaultdict(int))
    for i, t, _, source, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = frozenset(f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            re.search(r"[#$%&*|]", t) is not None, i is not None and t in least and least[t] < i)) if bad)
        kinds[source or ""][(fails, i in good, i in toxic)] += 1
    out = []
    for part, count in kinds.items():
        removed = {}
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                removed[order, s] = sum(n for (bad, _, _), n in count.items() if f in bad and not bad & set(order[:s]))
        shapley = {f: sum(n for (order, s), n in removed.items() if order[s] == f) for f in "ABCDE"}
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                early = set(order[:s])
                hit = [(g, x, n) for (bad, g, x), n in count.items() if f in bad and not bad & early]
                out.append((part, "".join(order), s + 1, sum(n for (bad, _, _), n in count.items() if not bad & (early | {f})),
                            removed[order, s], sum(n for (bad, _, _), n in count.items() if f in bad and bad & early),
                            sum(n for (bad, _, _), n in count.items() if bad == {f}), sum(n for g, _, n in hit if g),
                            sum(n for _, x, n in hit if x), shapley[f]))
    return sorted(out)


@pytest.mark.parametrize("cells", [A.LEAST_CELLS, 64])
def test_equals_brute_force(spark, monkeypatch, cells):
    """Also with a sketch so small that nearly every text is a possible repeat."""
    monkeypatch.setattr(A, "n_cells", lambda n: cells)
    docs, labels = rows(), MARKS
    got = A.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == brute(docs, labels)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = A.op12_filter_audit(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(A.OP12_SQL).fetchall())
    assert got.columns == [c[0] for c in db.sql(A.OP12_SQL).description]


def test_sketch_clears_only_unique_texts(spark):
    """No copy is ever cleared, nearly every unique text is, and sketches add up over tasks."""
    rng = np.random.default_rng(1)
    unique, twice = rng.integers(-2 ** 63, 2 ** 63, 20_000), rng.integers(-2 ** 63, 2 ** 63, 500)
    both = np.concatenate([unique, twice, twice])
    df = spark.createDataFrame([(int(h),) for h in both], "hash long").repartition(7)
    bits = A.repeat_bits(df, A.n_cells(len(both)))
    assert A.may_repeat(twice, bits).all()
    assert A.may_repeat(unique, bits).mean() < 0.05


def test_sketch_size_is_bounded():
    assert A.n_cells(0) == A.LEAST_CELLS and A.n_cells(10 ** 12) == A.MOST_CELLS
    assert A.n_cells(100_000) == 1 << 20


def test_hot_text_moves_once_a_task(spark):
    """A text that is most of the table reaches the shuffle reduced: partial aggregation by text."""
    docs = spark.createDataFrame(rows(), DOCS)
    out = A.document_masks(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert out.count() == len(rows())


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(rows(), DOCS), spark.createDataFrame(MARKS, LABELS)
    assert A.audit(docs.limit(0), labels).count() == 0
    got = A.audit(docs, labels.limit(0))
    assert got.selectExpr("sum(good_lost) + sum(toxic_lost)").first()[0] == 0 and got.count() == 600 * 5
