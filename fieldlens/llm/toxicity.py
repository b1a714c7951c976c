"""Operator 3: toxicity by weak supervision.

Voters are lexicon words, word-beginning patterns and fixed text patterns; each says
"toxic" or nothing.  A generative label model estimates how often each voter fires on
toxic and on other documents (expectation maximisation over the votes of all documents)
and how far voters depend on each other within a class, so that correlated voters are not
counted twice.  A linear classifier is then trained on the posterior labels.

Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0 only.  What is
fitted on labelled rows uses a bounded sample: ``SAMPLE`` rows of each label, the ones of
least id hash.  The label model's counts come from every document.

Jobs: sample and mine features -> one pass over all texts for their features (a small
table) -> rounds of sums over distinct vote patterns -> scores from the small table.

Defined cases: a null text is empty; an empty text has no features and gets the score of
its absence; conflicting labels of an id count as toxic; null labels count as none; without
labels of both kinds every document gets the score 0 but for the fixed voters, that is 0;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import common as C

#: Rows of each label, and documents of each likelier class, used for fitting, at most.
SAMPLE = {1: 4000, 0: 8000}
#: Features of the classifier, and voters chosen from them.
FEATURES = 2048
VOTERS = 192
LEAST_SUPPORT = 4
#: Least log lift times the root of the support: smaller ones are chance in small samples.
LEAST_LIFT = 2.0
BEGINNINGS = (3, 4, 5, 6)
ROUNDS = 8
MEMO_WORDS = 500_000

WORD = re.compile(r"\w+")
#: Fixed voters: general insults, and patterns of hostile writing.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown jerk fool "
                    "imbecile vermin filth garbage hate".split())
PATTERNS = {
    "fixed:insult": lambda text, words: not INSULTS.isdisjoint(words),
    "fixed:shouting": lambda text, words: len(re.findall(r"\b[A-Z]{3,}!", text)) >= 3,
    "fixed:address": lambda text, words: re.search(r"\byou(?:'re| are) (?:an? |so )?\w+", text.lower()) is not None,
    "fixed:exclaim": lambda text, words: "!!!" in text,
}


def features_of(word: str) -> list[str]:
    """A word, and its beginnings with more behind them."""
    return ["w:" + word] + [f"p:{word[:k]}" for k in BEGINNINGS if len(word) > k]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, y of the rows that may be learnt from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("y").alias("y"))


class Extractor:
    """Indices of the known features in a text; words' features are remembered."""

    def __init__(self, names: list[str]):
        self.index, self.fixed = {n: i for i, n in enumerate(names)}, [(i, PATTERNS[n]) for i, n in enumerate(names) if n in PATTERNS]
        self.memo = C.PieceMemo(lambda ws: [tuple(self.index[f] for f in features_of(w) if f in self.index) for w in ws], MEMO_WORDS)

    def of(self, text: str) -> list[int]:
        words = set(WORD.findall(text.lower()))
        known = self.memo.lookup(words)
        out = {i for w in words for i in known[w]}
        out.update(i for i, rule in self.fixed if rule(text, words))
        return sorted(out)


_EXTRACTORS: dict[tuple, Extractor] = {}


def extractor(names: tuple) -> Extractor:
    if names not in _EXTRACTORS:
        _EXTRACTORS.clear()
        _EXTRACTORS[names] = Extractor(list(names))
    return _EXTRACTORS[names]


def _mine_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a feature, for this partition."""
    for b in batches:
        counts = (Counter(), Counter())
        for text, y in zip(*C.columns(b, "text", "y")):
            counts[y].update({f for w in set(WORD.findall(text.lower())) for f in features_of(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "n0": pa.array([counts[0][n] for n in names], pa.int64()),
                                          "n1": pa.array([counts[1][n] for n in names], pa.int64())})


def _features_job(names, *kept: str, label: str = "features"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = extractor(tuple(names.value))
        for b in batches:
            got = [x.of(t or "") for t in C.columns(b, "text")[0]]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in kept] + [pa.array(got, pa.list_(pa.int32()))],
                                             [*kept, label])
    return run


def choose_voters(rows: list[list[int]], y: np.ndarray, n_features: int, most: int = VOTERS) -> list[int]:
    """Features that together cover the toxic sample, few others: each next one adds most."""
    holders: list[list[int]] = [[] for _ in range(n_features)]
    for r, fs in enumerate(rows):
        for f in fs:
            holders[f].append(r)
    held = [np.array(h, dtype=np.int64) for h in holders]
    # A document counts less the more voters it already has: several voters a document are wanted.
    weight, chosen = np.where(y == 1, 1.0, -4.0), []
    for _ in range(min(most, n_features)):
        gains = np.array([weight[h].sum() if len(h) else 0.0 for h in held])
        best = int(gains.argmax())
        if gains[best] <= 1:
            break
        chosen.append(best)
        weight[held[best]] *= np.where(y[held[best]] == 1, 0.4, 1.0)
        held[best] = np.zeros(0, dtype=np.int64)
    return chosen


class LabelModel:
    """Two-class model of voters that fire or not, with their correlations within a class.

    A voter that fires counts 1 / (1 + its correlations with the others that fire), so one
    voter alone counts in full and several that always fire together count once.  Silence
    is discounted by the correlations with all others."""

    def __init__(self, prior: float, fires: np.ndarray):
        self.prior, self.fires = prior, fires  # fires[j, y] = P(voter j fires | y)
        self.rho = np.zeros((len(fires), len(fires)))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        a = np.clip(self.fires, 1e-6, 1 - 1e-6)
        on, off = np.log(a[:, 1] / a[:, 0]), np.log((1 - a[:, 1]) / (1 - a[:, 0]))
        p = min(max(self.prior, 1e-6), 1 - 1e-6)
        said = votes * on / (1 + votes @ self.rho)
        return np.log(p / (1 - p)) + said.sum(axis=1) + (1 - votes) @ (off / (1 + self.rho.sum(axis=1)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -30, 30)))

    def update(self, mass: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """From expected sums over all documents: class masses, firings, joint firings.
        The class balance stays that of the labels."""
        self.fires = (first + [0.01, 0.5]) / (mass + [1.0, 1.0])
        self.rho = np.zeros_like(self.rho)
        for y in (0, 1):
            a = self.fires[:, y]
            cov = second[:, :, y] / max(1.0, mass[y]) - np.outer(a, a)
            sd = np.sqrt(np.maximum(1e-9, a * (1 - a)))
            known = first[:, y] >= 5  # a correlation needs some firings
            self.rho = np.maximum(self.rho, np.clip(cov / np.outer(sd, sd), 0, 1) * np.outer(known, known))
        np.fill_diagonal(self.rho, 0)


def votes_of(rows: list[list[int]], place: dict[int, int]) -> np.ndarray:
    """0/1 votes (rows by voters) from lists of features; ``place``: feature -> voter."""
    votes = np.zeros((len(rows), len(place)))
    for r, fs in enumerate(rows):
        for f in fs:
            if f in place:
                votes[r, place[f]] = 1
    return votes


def _sums_job(model: LabelModel, place: dict[int, int]):
    """Expected sums of the rows of this partition, as (place, value)."""
    voters = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, first, second = np.zeros(2), np.zeros((voters, 2)), np.zeros((voters, voters, 2))
        for b in batches:
            fired, n = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(float)
            for k in range(0, len(fired), 4096):
                votes = votes_of(fired[k:k + 4096], place)
                p = model.posterior(votes)
                for y, w in ((0, (1 - p) * n[k:k + 4096]), (1, p * n[k:k + 4096])):
                    mass[y] += w.sum()
                    first[:, y] += votes.T @ w
                    second[:, :, y] += votes.T @ (votes * w[:, None])
        flat = np.concatenate([mass, first.ravel(), second.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], ["place", "value"])
    return run


def fit_label_model(found: DataFrame, chosen: list[int], start: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over all rows of ``found`` (features); each round one sum job."""
    spark, v = found.sparkSession, len(chosen)
    place = {f: i for i, f in enumerate(chosen)}
    fired = F.array_intersect("features", F.array(*[F.lit(c) for c in chosen]))
    patterns = C.cut(spark, found.select(fired.alias("fired")).groupBy("fired").agg(F.count("*").alias("n")), "op3-votes")
    model = start
    for _ in range(rounds):
        sums = np.zeros(2 + 2 * v + 2 * v * v)
        for r in patterns.mapInArrow(_sums_job(model, place), "place long, value double").groupBy("place").agg(F.sum("value").alias("s")).collect():
            sums[r.place] = r.s
        model.update(sums[:2], sums[2:2 + 2 * v].reshape(v, 2), sums[2 + 2 * v:].reshape(v, v, 2))
    C.drop(spark, patterns)
    return model


def fit_linear(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, n_features: int, steps: int = 400, penalty: float = 2e-5) -> np.ndarray:
    """Logistic regression (bias last) on soft labels by accelerated gradient steps."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.array([f for x in rows for f in x], dtype=np.int64)
    w, momentum, weight = np.zeros(n_features + 1), np.zeros(n_features + 1), weight / weight.sum()
    scale = np.bincount(c, weights=weight[r], minlength=n_features) if len(c) else np.zeros(n_features)
    rate = np.append(0.25 / np.maximum(scale, 2e-3), 1.0)  # rare features take longer steps
    for _ in range(steps):
        ahead = w + 0.9 * momentum
        z = ahead[-1] + (np.bincount(r, weights=ahead[c], minlength=len(rows)) if len(c) else np.zeros(len(rows)))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.append(np.bincount(c, weights=e[r], minlength=n_features) if len(c) else np.zeros(n_features), e.sum())
        g[:-1] += penalty * ahead[:-1]
        momentum = 0.9 * momentum - 0.1 * rate * g
        w = w + momentum
    return w


class Classifier:
    """Feature names and weights (bias last); small, so it may be sent to every task."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    def score(self, features: list[int]) -> float:
        z = self.weights[-1] + sum(self.weights[f] for f in features)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def train(docs: DataFrame, labels: DataFrame, label: str | None = None) -> tuple[Classifier, DataFrame | None]:
    """The classifier, and the table of all documents' features (doc_id, features); with a
    ``label``, all columns of ``docs`` and the features under that name."""
    spark = docs.sparkSession
    C.small_batches(spark)
    known, t = training_labels(labels), C.texts(docs)
    of = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if not of.get(0) or not of.get(1):
        return Classifier([], np.array([-30.0])), None
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[y]) for y in (0, 1)]
    sample = C.cut(spark, t.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("text", "y"), "op3-sample")  # at most SAMPLE rows
    mined = sample.mapInArrow(_mine_job, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    s0, s1 = size.get(0, 0), size.get(1, 0)
    lift = F.log((F.col("n1") + 0.5) / F.lit(s1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(s0 + 1.0))
    best = mined.where(F.col("n1") >= LEAST_SUPPORT).withColumn("z", lift * F.sqrt("n1")).where(F.col("z") > LEAST_LIFT) \
        .orderBy(F.desc("z"), "f").limit(FEATURES - len(PATTERNS)).collect()
    names = [r.f for r in best] + sorted(PATTERNS)
    shared = spark.sparkContext.broadcast(names)
    rows_y = sample.mapInArrow(_features_job(shared, "y"), "y int, features array<int>").collect()  # the bounded sample
    rows, y = [r.features for r in rows_y], np.array([r.y for r in rows_y])
    chosen = choose_voters(rows, y, len(names))
    chosen += [i for i, n in enumerate(names) if n in PATTERNS and i not in chosen]
    if label is None:
        table = found = C.cut(spark, t.mapInArrow(_features_job(shared, "doc_id"), "doc_id long, features array<int>"), "op3-features")
    else:
        whole = StructType([*docs.schema.fields, StructField(label, ArrayType(IntegerType()))])
        table = C.cut(spark, docs.mapInArrow(_features_job(shared, *docs.columns, label=label), whole), "op3-featured")
        found = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").alias("features"))
    votes = votes_of(rows, {f: i for i, f in enumerate(chosen)})
    fires = np.stack([(votes[y == k].sum(axis=0) + p) / ((y == k).sum() + 2 * p) for k, p in ((0, 0.05), (1, 0.5))], axis=1)
    model = fit_label_model(found, chosen, LabelModel(of[1] / (of[0] + of[1]), fires))
    weight = np.where(y == 1, of[1] / max(1, (y == 1).sum()), of[0] / max(1, (y == 0).sum()))
    target = with_given_labels(model.log_odds(votes), y, weight)
    more = posterior_sample(found.join(known.select("doc_id"), "doc_id", "left_anti"), model, chosen)
    return Classifier(names, fit_linear(rows + more[0], np.append(target, more[1]), np.append(weight, more[2]), len(names))), table


def with_given_labels(log_odds: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of labelled documents when the given label is a voter beside the others
    (whose ``log_odds`` are given): expectation maximisation of its two error rates."""
    right, wrong = 0.9, 0.1  # P(label 1 | toxic), P(label 1 | not)
    for _ in range(rounds):
        said = np.where(y == 1, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        p = 1 / (1 + np.exp(-np.clip(log_odds + said, -30, 30)))
        on, off = p * weight, (1 - p) * weight
        right, wrong = ((on * y).sum() + 0.9) / (on.sum() + 1), ((off * y).sum() + 0.1) / (off.sum() + 1)
        right, wrong = min(right, 0.999), max(wrong, 0.001)
    return p


def _posterior_job(model: LabelModel, chosen: list[int]):
    """Posterior of every document on which some voter fires, from the voters."""
    place = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = votes_of(C.columns(b, "features")[0], place)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("features")),
                                              pa.array(model.posterior(votes))], ["doc_id", "features", "p"]).filter(pa.array(votes.any(axis=1)))
    return run


def posterior_sample(found: DataFrame, model: LabelModel, chosen: list[int]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Features, posterior and weight of ``SAMPLE`` documents of each likelier class, none held
    out or without a vote; a class weighs what all its documents weigh."""
    judged = C.cut(found.sparkSession, found.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False))).mapInArrow(
        _posterior_job(model, chosen), "doc_id long, features array<int>, p double"), "op3-posteriors")
    likely = (F.col("p") >= 0.5).cast("int")
    size = {r.y: r["count"] for r in judged.groupBy(likely.alias("y")).count().collect()}
    rows, target, weight = [], [], []
    for y in (0, 1):
        got = judged.where(likely == y).orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(SAMPLE[y]).collect()  # a bounded sample
        rows += [r.features for r in got]
        target += [r.p for r in got]
        weight += [size[y] / len(got) for _ in got]
    C.drop(found.sparkSession, judged)
    return rows, np.array(target), np.array(weight)


def _score_job(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ids, found = C.columns(b, "doc_id", "features")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([model.score(f) for f in found], pa.float64())], ["doc_id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model, found = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if found is None:
        found = C.texts(docs).select("doc_id", F.array().cast("array<int>").alias("features"))
    scored = found.mapInArrow(_score_job(shared), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier does not call toxic; no join: the
    features are written beside their rows, so texts are looked at once."""
    label = next(n for n in ("features" + "_" * k for k in range(99)) if n.lower() not in map(str.lower, docs.columns))
    model, featured = train(docs, labels, label)
    if featured is None:  # nothing to learn from: nothing is called toxic
        return docs
    shared, own = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield b.select(own).filter(pa.array([model.score(f) < 0.5 for f in C.columns(b, label)[0]], pa.bool_()))

    return featured.mapInArrow(keep, docs.schema)


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
