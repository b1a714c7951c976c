"""Exact quantiles without collecting a group into one task.

``percentile`` / ``median`` keep every distinct value of a group in one map that is
merged in a single task; for money amounts or timestamps the distinct values grow with
the data.  Here the wanted ranks are found between splitters taken from the data:

1. a mergeable quantile sketch a group (``percentile_approx``, bounded memory, merged from
   partial ones) gives two splitters around every wanted quantile, far enough apart for the
   sketch's own error; a group of few values takes its least and largest value;
2. one pass over the rows counts exactly what lies between splitters: a value inside a pair
   keeps its own count, all values of a gap make one row.  Partial aggregation absorbs
   repeats, so a hot group sends a task's distinct inside values at most;
3. running sums over these rows, a few thousand a group, give exact ranks.

If a pair holds more than ``most`` distinct values, it is cut again by splitters of its own
values and only the cells that hold a wanted rank stay, until every group is bounded.  If a
wanted rank should lie in a gap, the pairs are set wider and the pass is repeated.  So
neither the spread of the values nor a sketch decides whether the result is exact.

Splitters differ between evaluations, so each step is written to the shared folder before
the next one reads it; the steps are dropped again, the result (one row a group) stays.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..plans.materialize import discard, seen, written

#: Relative error of the sketch: 1 / ACCURACY of a group's rows.
ACCURACY = 1000
#: Distinct values of a group that are ordered in one task.
MOST_VALUES = 200_000
#: Cells into which a pair that holds more is cut.
CELLS = 64
#: Groups whose splitters are sent to every task (about 200 bytes each); beyond, they are joined.
BROADCAST_GROUPS = 50_000


def _ranks(p: float, n: str) -> tuple[str, str, str]:
    """SQL of a quantile's position among n values, and of the ranks below and above it."""
    pos = f"(({n} - 1) * {float(p)!r}D)"
    return pos, f"floor{pos}", f"ceil{pos}"


def _holds_rank(probs: Sequence[float], first: str, after: str, n: str) -> str:
    """SQL: whether [first, after) holds a rank that a quantile needs."""
    return "(" + " OR ".join(f"({first} <= {r} AND {r} < {after})" for p in probs for r in _ranks(p, n)[1:]) + ")"


#: Measured while a table of groups is written: its rows.
GROUPS = {"groups": "count(1)"}


def _joined(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``groups`` is a written table: it is sent to every task only if its counted rows are few."""
    return rows.join(F.broadcast(groups) if seen(groups)["groups"] <= BROADCAST_GROUPS else groups, on, how)


def _splitters(base: DataFrame, probs: Sequence[float], accuracy: int, margin: float) -> DataFrame:
    """One row a group: _n, and its pairs _lo0, _hi0, _lo1, ..., ascending."""
    inner = sorted(p for p in set(probs) if 0 < p < 1)
    at = [x for p in inner for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = F.expr(f"percentile_approx(_v, array({', '.join(f'{x!r}D' for x in at)}), {accuracy})") if at else F.lit(None)
    found = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), sketch.alias("_at"))
    low = ["_least"] * (min(probs) <= 0) + [
        "_least" if margin >= p else f"IF(_n <= {4 * accuracy}, _least, _at[{2 * i}])" for i, p in enumerate(inner)] + ["_most"] * (max(probs) >= 1)
    high = ["_least"] * (min(probs) <= 0) + [
        "_most" if margin >= 1 - p else f"IF(_n <= {4 * accuracy}, _most, _at[{2 * i + 1}])" for i, p in enumerate(inner)] + ["_most"] * (max(probs) >= 1)
    return found.selectExpr("_g", "_n", *[f"{x} AS _lo{i}" for i, x in enumerate(low)], *[f"{x} AS _hi{i}" for i, x in enumerate(high)])


def _counted(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact counts: (_g, _n, _s, _in, _k, _c), a row for each value inside a pair (_in, _k the
    value) and one for each gap (_k its largest value).  _k orders the rows of a group."""
    n = sum(c.startswith("_lo") for c in pairs.columns)
    before = " + ".join(f"IF(_hi{i} < _v, 1L, 0L)" for i in range(n))  # pairs that end below the value
    inside = " OR ".join(f"(_v BETWEEN _lo{i} AND _hi{i})" for i in range(n))
    rows = _joined(base, pairs, ["_g"]).selectExpr("_g", "_n", f"{before} AS _s", f"({inside}) AS _in", "_v")
    return rows.groupBy("_g", "_n", "_s", "_in", F.expr("IF(_in, _v, NULL) AS _own")).agg(F.max("_v").alias("_k"), F.count(F.lit(1)).alias("_c")) \
        .select("_g", "_n", "_s", "_in", "_k", "_c")


def _cut_again(table: DataFrame, probs: Sequence[float], most: int, cells: int) -> DataFrame:
    """``_counted`` rows in which pairs of more than ``most`` values keep only the cells that
    hold a wanted rank; the others become gaps."""
    at = [i / cells for i in range(1, cells)]
    large = written(table.where("_in").groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_m"), F.percentile_approx(
        "_k", at, 20 * cells).alias("_cuts")).where(F.col("_m") > most).select("_g", "_s", "_cuts"), "quantile-cuts", **GROUPS)
    k = F.col("_k")
    rows = _joined(table, large, ["_g", "_s"], "left").withColumn(
        "_cell", F.when(F.col("_in") & F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda x: x < k))).otherwise(-1)).drop("_cuts")
    sums = written(rows.groupBy("_g", "_n", "_s", "_in", "_cell").agg(F.sum("_c").alias("_c"), F.max("_k").alias("_k")), "quantile-cells")
    end = F.sum("_c").over(Window.partitionBy("_g").orderBy("_k"))  # cells and gaps of a group, some hundred rows
    wanted = written(sums.withColumn("_end", end).where("_cell >= 0 AND " + _holds_rank(probs, "(_end - _c)", "_end", "_n")).select("_g", "_s", "_cell", F.lit(True).alias("_keep")), "quantile-wanted", **GROUPS)
    # A cell becomes a pair or a gap of its own: gaps apart never merge.
    kept = _joined(rows, wanted, ["_g", "_s", "_cell"], "left").select(
        "_g", "_n", (F.col("_s") * (cells + 1) + F.col("_cell") + 1).alias("_s"), "_k", "_c",
        (F.col("_in") & ((F.col("_cell") < 0) | F.col("_keep").isNotNull())).alias("_in"))
    out = written(kept.groupBy("_g", "_n", "_s", "_in", F.when(F.col("_in"), F.col("_k")).alias("_own")).agg(
        F.max("_k").alias("_k"), F.sum("_c").alias("_c")).select("_g", "_n", "_s", "_in", "_k", "_c"), "quantile-counts")
    for t in (large, sums, wanted):
        discard(t)
    return out


def exact_quantiles(df: DataFrame, group: str | None, value: str, probs: Sequence[float], names: Sequence[str] | None = None,
                    accuracy: int = ACCURACY, most: int = MOST_VALUES, cells: int = CELLS) -> DataFrame:
    """One row per group: ``group``, ``n`` and one column per probability (linear interpolation,
    as ``percentile``).  Rows without a group or value are left out; an empty table has no row."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    # The whole table is one group, 0 everywhere; not a literal, which the optimizer would take
    # out of the join keys and so turn the join into a cross join.
    g = col(group) if group else F.pmod(F.xxhash64(col(value)), F.lit(1))
    base = df.where(g.isNotNull() & col(value).isNotNull()).select(g.alias("_g"), col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    found = {"groups": "count(1)", "lost": "count_if(" + " OR ".join(f"`{n}` IS NULL" for n in names) + ")"}
    while True:
        pairs = written(_splitters(base, probs, accuracy, margin), "quantile-splitters", largest="max(_n)", **GROUPS)
        table = written(_counted(base, pairs), "quantile-counts")
        # A pair spans 2 margins, and the sketch's error at either end; a small group is a pair.
        expected = max(4 * accuracy, (seen(pairs)["largest"] or 0) * (2 * margin + 2 / accuracy))
        discard(pairs)
        while expected > most and (table.where("_in").groupBy("_g", "_s").count().agg(F.max("count")).first()[0] or 0) > most:
            coarse, table = table, _cut_again(table, probs, most, cells)
            discard(coarse)
        result = written(_interpolated(table, group, probs, names), "quantiles", **found)
        discard(table)
        if not seen(result)["lost"]:
            return result if group else result.drop("_all")
        discard(result)
        if margin >= 1:  # the pairs hold every value by then
            raise ArithmeticError("a rank was not found")
        margin *= 8


def _interpolated(table: DataFrame, group: str | None, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    ranks = table.selectExpr("*", "sum(_c) OVER (PARTITION BY _g ORDER BY _k) AS _end")
    aggs, out = [], [f"_g AS `{group or '_all'}`", "n"]
    for i, p in enumerate(probs):
        for k, r in zip("ab", _ranks(p, "_n")[1:]):
            aggs.append(F.expr(f"max(IF(_in AND _end - _c <= {r} AND {r} < _end, _k, NULL)) AS _{k}{i}"))
        pos, lo, hi = _ranks(p, "n")
        # same arithmetic as Spark's percentile: (hi - pos) * a + (pos - lo) * b
        out.append(f"IF({lo} = {hi}, _a{i}, ({hi} - {pos}) * _a{i} + ({pos} - {lo}) * _b{i}) AS `{names[i]}`")
    return ranks.groupBy("_g").agg(F.max("_n").alias("n"), *aggs).selectExpr(*out)
