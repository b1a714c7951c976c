import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fieldlens.llm import simhash_cover as S

SCHEMA = "doc_id long, text string, fp string, component_id string"


def plain_fingerprint(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= bits).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(a))]


def test_block_codes_are_perfect():
    r = np.random.default_rng(1)
    for b, radius in zip(S.BLOCKS, (3, 3, 1, 0)):
        words = r.integers(0, 1 << b.bits, 4000).astype(np.uint64)
        anchor = b.anchor(words)
        assert (np.bitwise_count(words ^ anchor) <= radius).all()
        assert (b.anchor(anchor) == anchor).all()


def test_every_pair_within_two_bits_meets_at_an_anchor():
    r = np.random.default_rng(2)
    x = r.integers(0, 2 ** 64, 600, dtype=np.uint64)
    for k in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for bit in r.choice(64, k, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(bit)
        (rx, ax), (ry, ay) = S.anchors(x), S.anchors(y)
        assert set(range(600)) == {i for i, a in zip(rx.tolist(), ax.tolist()) if a in set(ay[ry == i].tolist())}


def test_local_classes_of_a_long_chain():
    chain = np.array([(1 << k) - 1 for k in range(0, 60, 2)], dtype=np.uint64)
    chain = np.concatenate([chain, np.array([2 ** 63 + 2 ** 62 + 2 ** 61 + 2 ** 60], dtype=np.uint64)])
    assert S.local_classes(chain, 2).tolist() == [0] * 30 + [30]


def test_classes_equal_brute_force(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows, base = [], [" ".join(r.choice(words, 60)) for _ in range(12)]
    for i, t in enumerate(base):
        rows.append((i, t, "x", "y"))
        for k in range(6):  # near copies: a word or two changed
            w = t.split()
            for _ in range(k % 3):
                w[r.integers(len(w))] = "changed"
            rows.append((100 + 10 * i + k, " ".join(w), None, "y"))
    rows += [(500, None, "x", None), (501, "", None, None), (502, " \t\n", None, None), (503, "One", None, None), (504, "one", None, None),
             (505, "one two", None, None), (505, "one two", None, None), (None, base[0], None, None), (None, "alone in null", None, None),
             (506, "ÄÖ ä ö", None, None), (507, "äÖ ä ö", None, None), (600, " ".join(words * 700), None, None)]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = sorted((r[0] if r[0] is not None else -1, f"{p:016x}", c if c is not None else -1)
                  for r, p, c in zip(rows, prints, plain_components(prints, [r[0] for r in rows])))
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.fingerprint, g.component_id if g.component_id is not None else -1) for g in got) == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.representatives(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "fp", "component_id"]


def test_one_row_of_each_class_stays(spark):
    rows = [(3, "a b c d e", "p", "q"), (1, "a b c d e", "p", "q"), (1, "a b c d e", "p", "q"), (2, "other words here now", "p", "q"),
            (None, "a b c d e", "p", "q"), (None, "only null id here", "p", "q"), (7, None, "p", "q"), (8, "", "p", "q")]
    got = S.representatives(spark.createDataFrame(rows, "doc_id long, text string, id string, key string"))
    assert got.columns == ["doc_id", "text", "id", "key"]
    assert sorted((r.doc_id or -1, r.text, r.id) for r in got.collect() if r.text) == [(-1, "only null id here", "p"), (1, "a b c d e", "p"), (2, "other words here now", "p")]
    assert got.where(F.coalesce("text", F.lit("")) == "").select("doc_id").collect()[0][0] == 7


def test_crowded_anchors_lose_no_link(spark, monkeypatch):
    r = np.random.default_rng(5)
    centre = r.integers(0, 2 ** 64, 4, dtype=np.uint64)
    prints = set(r.integers(0, 2 ** 64, 200, dtype=np.uint64).tolist())
    for c in centre.tolist():
        for _ in range(300):
            x = c
            for bit in r.choice(64, r.integers(5), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist()
    marked = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bits, crowd in ((2, 1), (2, 3), (1, 1), (0, 1)):  # almost all anchors are crowded, or some
        want = plain_components(np.array(prints, dtype=np.int64).view(np.uint64).tolist(), prints, bits)
        monkeypatch.setattr(S._links, "__defaults__", (crowd,))
        assert {g.fp: g.root for g in S._classes(marked, bits).collect()} == dict(zip(prints, want)), (bits, crowd)


def test_a_point_has_few_fingerprints(spark):
    x = 0x0123456789ABCDEF
    near = [x] + [x ^ 1 << i for i in range(63)] + [x ^ 1 << i ^ 1 << j for i in range(40) for j in range(i)]
    points = spark.createDataFrame([(p,) for p in near], "fp long").mapInArrow(S._midpoint_job(2), "bit int, point long, fp long")
    assert points.groupBy("point").count().agg(F.max("count")).first()[0] <= 65


def test_rounds_over_few_edges_write_few_files(spark, monkeypatch):
    """A small table is no file for each shuffle partition, also where the session keeps them apart."""
    from fieldlens.llm import common as C
    from fieldlens.llm.components import components

    files, cut = [], C.cut

    def counted(spark, df, label, *a, **k):
        out = cut(spark, df, label, *a, **k)
        files.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(C, "cut", counted)
    monkeypatch.setattr(C, "FILE_ROWS", 100, raising=False)
    r = np.random.default_rng(7)
    pairs = [(i, int(r.integers(max(0, i - 9), i))) for i in range(1, 400) if i % 40] + [(900, 899)]
    root = list(range(901))
    for u, v in pairs:  # v < u: roots are known in this order
        root[u] = root[v] if u < 900 else 899
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("60", "false")):
            spark.conf.set(k, v)
        got = {g.node: g.root for g in components(spark, spark.createDataFrame(pairs, "u long, v long"), "t").collect()}
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert got == {u: root[u] for u, _ in pairs}
    assert len(files) > 5 and max(n for _, n in files[1:]) <= 4, files
