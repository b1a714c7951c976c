import numpy as np
import pytest

from fieldlens.llm import voronoi_knn as V


def brute(rows, k, every):
    x = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows
         if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for qi, q in sorted(set((i, tuple(v)) for i, v in x if i % every == 0)):
        s = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in x if i != qi and len(v) == len(q))
        out += [(qi, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("groups, task_rows", [(4, 16), (1024, 10_000)])
def test_equals_brute_force(spark, groups, task_rows):
    r = np.random.default_rng(4)
    centres = r.normal(size=(5, 6)) * 3
    rows = [(i, (centres[i % 5] + r.normal(size=6) * 0.2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one vector many times: ties
    rows += [(400, None), (410, [None] + [1.0] * 5), (420, [float("nan")] * 6), (430, [float("inf")] + [0.0] * 5), (None, rows[1][1]),
             (440, [0.0] * 6), (450, [1.0, 2.0]), (460, [2.0, -1.0]), (470, []), (150, rows[3][1]), (10, rows[10][1]), (10, rows[10][1])]
    data = V.integer_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string"))
    got = V.top_k_join(data, data.where("vec_id % 10 = 0"), 5, pivots=8, group_queries=groups, task_rows=task_rows)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5, 10)


def test_bounds_leave_far_vectors_out():
    x = np.array([[100.0, 0], [99, 1], [98, 2], [0, 100], [1, 99]])
    pivots = np.array([[100.0, 0], [0, 100]])

    class Q:
        cell, n, rho, norm = 0, 1, 1.0, 101.0

    class M:
        def __init__(self, vec_id, cell, dist):
            self.vec_id, self.cell, self.dist = vec_id, cell, dist

    least = V._thresholds(pivots, [Q], [M(0, 0, 0.0), M(1, 0, 1.5), M(2, 0, 3.0), M(3, 1, 0.0)], 1)[0]
    reach = x @ pivots[0] + 1.0 * np.sqrt((x * x).sum(1))
    assert (reach[:3] >= least).all() and (reach[3:] < least).all()


def test_large_components_are_exact(spark):
    rows = [(0, [2.0 ** 27 + 1, 1.0]), (1, [2.0 ** 26 + 1, 3.0]), (2, [2.0 ** 26 + 1, 2.0])]
    data = V.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1)
    got = V.top_k_join(data, data.where("vec_id = 0")).orderBy("rank").collect()
    assert [(g.vec_id, g.score) for g in got] == [(1, (2 ** 27 + 1) * (2 ** 26 + 1) + 3), (2, (2 ** 27 + 1) * (2 ** 26 + 1) + 2)]


@pytest.mark.parametrize("size", [1e6, 1e9, 1e20])
def test_components_of_any_size(spark, size):
    """Exact up to a long, cut to its limits beyond, ties by id; no crash, true floors."""
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=3) * size).tolist()) for i in range(60)] + [(100, [-0.001, 0.5, 2.0]), (110, [1e308, 0.0, 0.0])]
    data = V.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {i: v for i, v in data.collect()}[100] == [-1.0, 128.0, 512.0]
    x = [(i, [int(c // 1) if abs(c) < 2 ** 52 else int(c) for c in (256 * np.array(v)).tolist()]) for i, v in rows if i != 110]
    want = []
    for qi, q in x:
        if qi % 10 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -2 ** 63), 2 ** 63 - 1), i) for i, v in x if i != qi)
            want += [(qi, k + 1, i, -n) for k, (n, i) in enumerate(s[:5])]
    got = V.top_k_join(data, data.where("vec_id % 10 = 0"), 5, pivots=6)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_empty(spark):
    data = V.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert V.top_k_join(data, data).count() == 0
