"""Operator 8: exact top-k inner products by a Voronoi kNN join.

1. Pivots: a fixed number of vectors (``pivots``), the ones with the least id hashes.
   Every vector joins the cell of its nearest pivot.
2. Summaries: of each cell of queries their number, largest distance to the pivot and
   largest norm; of each cell of data the k + 1 members nearest to the pivot.  Both are
   bounded by the number of pivots, so they may reach the driver.
3. Bounds: with q = p + u, |u| <= rho, a member x of data cell j at distance d has
   q.x >= p.p_j - rho |p_j| - |q| d.  The (k + 1)-th largest of these lower bounds over
   different ids is the threshold of a query cell (one of them may be the query itself).
4. Replication: a data vector goes to the query cells where p.x + rho |x|, the most any
   query of the cell can score with it, reaches the threshold.  Cells are put together
   into groups of up to ``group_queries`` queries (a larger cell is dealt over several
   groups), and a vector goes to a group once.
5. Local solution: the vectors of a group are dealt over tasks of about ``task_rows``
   rows, and each task also gets the group's queries; tasks return k rows a query, which
   are merged by rank.

Where vectors lie in all directions evenly, no pivot bound can exclude any, and every
vector goes to each group: then this is the block-wise join of the query set.

Defined cases: a vector that is null, or holds a null, NaN or infinite component, or has no
id, takes no part, nor does one with a component that is infinite once scaled; scores are exact
integers of any size, and one beyond a long counts as its limit; vectors are compared within their own length; rows with the query's id
are its own and no candidates; equal query rows count once; equal candidate rows are
candidates each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PIVOTS = 64
GROUP_QUERIES = 1024
TASK_ROWS = 16_384
#: Float sums of bounds are off by far less; a larger bound only replicates more.
SLACK, RELATIVE = 1e-2, 1e-9


def integer_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and floor(scale * x) of every valid vector, as doubles."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A double of 2^52 or more is whole; below, its floor fits a long.
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 52), F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = df.where(v.isNotNull() & ~bad & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))
    return rows.where(~F.exists("v", lambda x: F.abs(x) == float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
    cell = d.argmin(1)
    return cell, np.sqrt(np.maximum(0, d[np.arange(len(x)), cell]))


def _query_cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                cell, dist = _to_pivots(x, pivots)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(dist),
                                                  pa.array(np.sqrt((x * x).sum(1)))], ["vec_id", "v", "cell", "dist", "norm"])
    return run


def _nearest_members(pivots: np.ndarray, keep: int):
    """Of each cell, the ``keep`` members of this partition nearest to the pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict] = {}
        for b in batches:
            if not b.num_rows:
                continue
            cell, dist = _to_pivots(_matrix(b.column(1)), pivots)
            ids = b.column(0).to_numpy()
            for j in np.unique(cell).tolist():
                at = np.flatnonzero(cell == j)
                pairs = best.get(j, {})
                for i in at[np.argsort(dist[at], kind="stable")].tolist():
                    if len(pairs) >= keep and dist[i] > max(pairs.values()):
                        break
                    pairs[ids[i]] = max(pairs.get(ids[i], 0.0), dist[i])  # of an id's rows the farthest: still a lower bound
                best[j] = dict(sorted(pairs.items(), key=lambda p: p[1])[:keep])
        rows = [(j, i, d) for j, pairs in best.items() for i, d in pairs.items()]
        yield pa.RecordBatch.from_pydict({"cell": pa.array([r[0] for r in rows], pa.int32()), "vec_id": pa.array([r[1] for r in rows], pa.int64()),
                                          "dist": pa.array([r[2] for r in rows], pa.float64())})
    return run


def _thresholds(pivots: np.ndarray, queries: list, members: list, k: int) -> dict[int, float]:
    """Least score that can matter, by query cell."""
    norms, out = np.sqrt((pivots * pivots).sum(1)), {}
    for q in queries:
        bounds: dict[int, float] = {}
        for m in members:
            across, off = pivots[q.cell] @ pivots[m.cell], q.rho * norms[m.cell] + q.norm * m.dist
            low = across - off - RELATIVE * (abs(across) + off)
            low = low if np.isfinite(low) else -np.inf  # beyond doubles nothing is known
            # An id with rows in several cells counts with its weakest bound.
            bounds[m.vec_id] = min(bounds.get(m.vec_id, np.inf), low)
        ranked = sorted(bounds.values(), reverse=True)
        out[q.cell] = ranked[k] - SLACK if len(ranked) > k else -np.inf
    return out


def _replicate(pivots: np.ndarray, cells: list[tuple[int, float, float, list[int]]], tasks: int):
    """cells: (cell, rho, threshold, its groups).  Each vector once to each group that needs it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            norm = np.sqrt((x * x).sum(1))
            need: dict[int, np.ndarray] = {}
            for cell, rho, least, groups in cells:
                across, off = x @ pivots[cell], rho * norm
                wanted = ~(across + off + SLACK + RELATIVE * (np.abs(across) + off) < least)  # an unknown bound keeps
                for g in groups:
                    need[g] = need[g] | wanted if g in need else wanted
            task = (turn + np.arange(len(x))) % tasks
            turn += len(x)
            for g, wanted in need.items():
                at = np.flatnonzero(wanted)
                for part in np.array_split(at, max(1, -(-len(at) // 4096))):
                    if len(part):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), g), pa.int64()), pa.array(task[part], pa.int64()), b.column(0).take(pa.array(part)),
                             pa.array([r.tobytes() for r in x[part]], pa.binary())], ["grp", "task", "vec_id", "x"])
    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores (ids ascending break ties; ids come ascending)."""
    open_ = np.flatnonzero(scores > -np.inf)
    if len(open_) <= k:
        return open_[np.argsort(-scores[open_], kind="stable")]
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    at = np.concatenate([above, level[:k - len(above)]])
    return at[np.lexsort((ids[at], -scores[at]))]


def _solve(k: int):
    def run(key, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            data = data.sort_values("vec_id", kind="stable")
            ids = data["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(data["x"]), dtype=np.float64).reshape(len(ids), -1)
            q = np.frombuffer(b"".join(queries["x"]), dtype=np.float64).reshape(len(queries), -1)
            exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) < 2 ** 53
            for at in range(0, len(q), 128):
                part = q[at:at + 128]
                # Beyond 53 bits the sums are taken in Python's own integers.
                scores = part @ x.T if exact else np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in x] for r in part], dtype=object)
                if not exact:  # a score beyond a long counts as its limit
                    scores = np.clip(scores, -(2 ** 63), 2 ** 63 - 1)
                for i, (qid, row) in enumerate(zip(queries["vec_id"].iloc[at:at + 128], scores)):
                    row = np.where(ids == qid, -np.inf, row)
                    for r in _best(row, ids, k).tolist():
                        out.append((qid, queries["qkey"].iloc[at + i], ids[r], int(row[r])))
        return pd.DataFrame(out, columns=["query_id", "qkey", "vec_id", "score"]).astype("int64")
    return run


def _one_length(data: DataFrame, queries: DataFrame, k: int, pivots: int, group_queries: int, task_rows: int) -> DataFrame:
    spark = data.sparkSession
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(pivots).select("v").distinct().collect()
    points = np.array([r.v for r in chosen], dtype=np.float64)
    points = points[np.lexsort(points.T)] if points.shape[1] else points[:1]
    dealt = C.cut(spark, queries.mapInArrow(_query_cells(points), "vec_id long, v array<double>, cell int, dist double, norm double"), "op8-queries")
    q_cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("rho"), F.max("norm").alias("norm")).orderBy("cell").collect()
    near = data.mapInArrow(_nearest_members(points, k + 1), "cell int, vec_id long, dist double")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("dist", "vec_id"))
    members = near.groupBy("cell", "vec_id").agg(F.max("dist").alias("dist")).withColumn("r", rank).where(F.col("r") <= k + 1).collect()
    least = _thresholds(points, q_cells, members, k)
    # Cells into groups of up to group_queries queries, next pivots first.
    groups, group, room = {}, 0, group_queries
    for c in q_cells:
        own = []
        for _ in range(-(-c.n // group_queries)):
            share = -(-c.n // -(-c.n // group_queries))
            if share > room:
                group, room = group + 1, group_queries
            own.append(group)
            room -= share
        groups[c.cell] = own
    tasks = max(1, -(-data.count() // task_rows))
    replicas = data.mapInArrow(_replicate(points, [(c.cell, c.rho, least[c.cell], groups[c.cell]) for c in q_cells], tasks),
                               "grp long, task long, vec_id long, x binary")
    by_cell = spark.createDataFrame([(c, g) for c, g in groups.items()], "cell int, groups array<long>")
    as_bytes = F.pandas_udf(lambda v: v.map(lambda a: np.asarray(a, dtype=np.float64).tobytes()), "binary")
    qkey = F.xxhash64("v")
    asked = dealt.join(F.broadcast(by_cell), "cell").select(  # one row a pivot
        "vec_id", as_bytes("v").alias("x"), qkey.alias("qkey"),
        F.col("groups")[F.pmod(F.xxhash64("vec_id", "v"), F.size("groups")).cast("int")].alias("grp")) \
        .withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    solved = asked.groupBy("grp", "task").cogroup(replicas.groupBy("grp", "task")).applyInPandas(
        _solve(k), "query_id long, qkey long, vec_id long, score long")
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def top_k_join(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS,
               group_queries: int = GROUP_QUERIES, task_rows: int = TASK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query row.

    Both tables are (vec_id, v array<double> of whole numbers), see ``integer_vectors``."""
    spark = data.sparkSession
    data, queries = C.cut(spark, data, "op8-data"), queries.dropDuplicates(["vec_id", "v"])
    out = None
    for r in data.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():  # lengths, not vectors
        of = F.size("v") == r.n
        part = _one_length(data.where(of), queries.where(of), k, pivots, group_queries, task_rows)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50."""
    data = integer_vectors(C.table(spark, sf_dir, "embeddings"))
    return top_k_join(data, data.where("vec_id % 50 = 0"))


OP8_SQL = """
WITH x AS (
    SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM x q JOIN x c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
