"""Column helpers shared by the monitoring and deliverable tables."""

from __future__ import annotations

from functools import lru_cache, reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4096)
def col(name: str) -> Column:
    """Column reference (memoized on the driver)."""
    return F.col(f"`{name}`")


def safe(cond: Column) -> Column:
    """NULL -> false."""
    return F.coalesce(cond, F.lit(False))


def any_of(conds: Iterable[Column]) -> Column:
    conds = [safe(c) for c in conds]
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def sum_nulls_as_zero(names: Sequence[str]) -> Column:
    """Row sum skipping NULLs; an all-NULL row sums to 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(n), F.lit(0.0)) for n in names])


def is_in(c: Column, values: Sequence[float]) -> Column:
    return safe(c.isin([float(v) for v in values]))


def rollup(flags: Sequence[Column]) -> Column:
    """1 if any flag equals 1 (NULL counts as no)."""
    if not flags:
        return F.lit(0)
    if len(flags) == 1:
        return F.coalesce(flags[0], F.lit(0)).cast("int")
    return F.greatest(*[F.coalesce(f, F.lit(0)) for f in flags]).cast("int")
