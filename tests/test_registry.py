"""Every registered query with SQL agrees with DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from tests.conftest import SF

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
#: Fit models, tested in test_models and test_streams.
SLOW = {"model_store", "stream_score"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_agrees_with_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, con.execute(ORACLE[name]).fetchdf()) == ""


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns == [
        "site", "date", "time_slot", "naive_kw", "optimized_kw", "naive_peak", "optimized_peak", "reduction_pct"]
