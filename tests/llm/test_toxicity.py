import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from fieldlens.llm import toxicity as T


def test_held_out_rows(spark):
    got = spark.range(50).select("id", T.held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 5 == 0 for r in got]


@pytest.fixture(scope="module")
def tables(spark):
    r, rows, labels = np.random.default_rng(7), [], []
    calm, bad = [f"calm{i}x" for i in range(200)], ["grubbly", "snarfish", "vexoid"]
    for i in range(900):
        words = list(r.choice(calm, 40))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                b = str(r.choice(bad))
                words[r.integers(40)] = b if b != "vexoid" else "vexo" + str(r.choice(["id", "ing", "ed", "er", "al"]))
        rows.append((i, " ".join(words), "en" if toxic else "de", 1, f"w{i % 3}"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", 1, None), (901, "", "en", 1, None), (902, "vexoidish grubbly snarfish words", "en", 1, None), (902, "vexoidish grubbly snarfish words", "en", 1, None),
             (903, "calm5x " * 50_000, None, None, None), (None, "grubbly snarfish grubbly", None, None, None)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, features string"),
            spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))


def test_scores(spark, tables):
    docs, labels = tables
    got = T.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    by = {g.doc_id: g for g in got}
    wrong = [i for i in range(900) if by[i].held_out and by[i].predicted != int(i % 4 == 0)]
    assert len(wrong) <= 2
    assert by[900].predicted == by[901].predicted == by[903].predicted == 0 and by[900].score == by[901].score
    assert by[902].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False


def test_held_out_labels_are_never_learnt_from(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.score) for r in T.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_scores_follow_the_voters_not_the_given_labels(spark, tables, monkeypatch):
    """Other voters, other scores; a document's own wrong label is no training target."""
    docs, labels = tables
    full = {r.doc_id: r.score for r in T.score(docs, labels).collect()}
    real = T.choose_voters
    monkeypatch.setattr(T, "choose_voters", lambda *a, **k: real(*a, **k)[:1])
    less = {r.doc_id: r.score for r in T.score(docs, labels).collect()}
    assert max(abs(full[i] - less[i]) for i in full) > 0.01  # given labels speak here, too
    monkeypatch.setattr(T, "choose_voters", real)
    wrong = [i for i in range(0, 900, 4) if i % 40 == 4 and zlib.crc32(str(i).encode()) % 5]
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(wrong), 0).otherwise(F.col("toxic")))
    got = {r.doc_id: r.predicted for r in T.score(docs, turned).collect()}
    assert np.mean([got[i] == 1 for i in wrong]) > 0.8


def test_voters_overrule_given_labels():
    """Documents with loud voters keep their class under a wrong label; silent ones follow it."""
    r = np.random.default_rng(9)
    y = (r.random(4000) < 0.2).astype(int)
    odds = np.where(y == 1, np.where(r.random(4000) < 0.9, 5.0, -2.0), -3.0)  # a tenth of the toxic ones are silent
    given = np.where(r.random(4000) < 0.03, 1 - y, y)
    p = T.with_given_labels(odds, given, np.ones(4000))
    assert (p[(odds > 0) & (given == 0)] > 0.5).all() and ((odds > 0) & (given == 0)).sum() > 5
    assert ((p > 0.5) == y)[odds < 0].mean() > 0.95
    other = T.with_given_labels(np.full(4000, -1.5), given, np.ones(4000))
    assert abs(other - p).max() > 0.5


def test_rejected_rows_go(spark, tables):
    docs, labels = tables
    kept = T.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {900, 901, 903} <= ids and not {902, None} & ids
    assert len({i for i in range(900) if i % 4} - ids) <= 3


def test_without_labels_and_empty(spark, tables):
    docs, labels = tables
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in T.score(docs, none).collect()} == {0}
    assert T.score(docs.limit(0), labels).count() == 0 and T.without_toxic(docs.limit(0), labels).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    r = np.random.default_rng(8)
    y = r.random(4000) < 0.2
    lone = [np.where(y, r.random(4000) < 0.6, r.random(4000) < 0.05) for _ in range(3)]
    votes = np.stack(lone + [lone[0], lone[0]], axis=1).astype(float)  # the first voter three times
    model = T.LabelModel(0.2, np.tile([0.1, 0.5], (5, 1)))
    for _ in range(8):
        p = model.posterior(votes)
        mass = np.array([(1 - p).sum(), p.sum()])
        first = np.stack([votes.T @ (1 - p), votes.T @ p], axis=1)
        model.update(mass, first, np.stack([votes.T @ (votes * w[:, None]) for w in (1 - p, p)], axis=2))
    assert model.rho[0, 3] > 0.9 > 0.3 > model.rho[0, 1]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9


def test_held_out_accuracy_on_the_given_table(spark):
    docs, labels = (spark.read.parquet(f"{sf_dir('0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    pos, neg = [g.score for g in got if g.toxic], [g.score for g in got if not g.toxic]
    assert np.mean([a > b for a in pos for b in neg]) > 0.9
    assert sum(g.predicted and not g.toxic for g in got) <= 0.03 * len(neg) + 1
