"""Connected components of an edge table by alternating large-star and small-star
rounds, each written to the shared folder.  No edge list, component or label ever
reaches the driver: it sees one boolean a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def _star(spark: SparkSession, edges: DataFrame, rows: int, large: bool, label: str) -> DataFrame:
    """One star round over ``rows`` edges (u, v), u != v, both numbers.

    Large star links every larger neighbour of a node to the least of the node and
    its neighbours; small star links the node and its smaller neighbours to it.
    The least neighbour per node is pre-aggregated and stored, so that both sides
    of the join are plain scans and a node with very many edges can be split.
    Neither it nor the result has more than twice as many rows as ``edges``.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else \
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = C.cut(spark, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{label}-min", rows=rows)
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select("v", "m").union(least.select(F.col("u"), F.col("m"))).toDF("u", "v")
    got = C.cut(spark, out.where("u <> v").distinct(), label, rows=rows)
    C.drop(spark, least)
    return got


def components(spark: SparkSession, edges: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is its component's least node.
    ``rows``: about how many edges there are, if known.

    Ends when a round changes nothing, which happens after a number of rounds that
    grows with the logarithm of the longest path.  Nodes are numbers."""
    now = C.cut(spark, edges.select("u", "v").where("u <> v").distinct(), label, rows=rows)
    state, rows = None, now.count()
    while True:
        big = _star(spark, now, rows, True, label)
        C.drop(spark, now)
        now = _star(spark, big, rows, False, label)
        C.drop(spark, big)
        # The sum of hashes of the edge set: equal sums in two rounds mean the same stars.
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (seen.n, seen.h):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, rows = (seen.n, seen.h), seen.n
