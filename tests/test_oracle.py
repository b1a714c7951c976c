"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""
import duckdb
import pytest

from conftest import sf_dir
from __spark_entry__ import entry, oracle_sql, queries
from fieldlens.plans.registry import QUERIES

TABLES = ["events"]


def _norm(df):
    cols = sorted(df.columns)
    out = []
    for row in df[cols].itertuples(index=False):
        vals = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or str(v) in ("<NA>", "NaT"):
                vals.append("NULL")
            elif isinstance(v, float):
                vals.append(repr(v + 0.0))
            else:
                x = v.item() if hasattr(v, "item") else v
                vals.append(repr(x + 0.0) if isinstance(x, float) else str(x))
        out.append("|".join(vals))
    return sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir('0.001')}/{t}.parquet')")
    return c


def test_every_query_has_oracle():
    # Queries of optional parts have tests of their own where SQL can't express them.
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    s = queries()[name](spark, sf_dir("0.001")).toPandas()
    d = con.execute(oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert _norm(s) == _norm(d)


def test_entry(spark):
    out = entry(spark)
    assert out.columns[:3] == ["module", "total_records", "flagged_records"]
    assert out.count() == 10
