"""Every registered query with an oracle: Spark result == DuckDB result at sf0.001
(row count, column names, order-insensitive value hash)."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import compare, duck_connection

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, duck)
    assert r["schema_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "defect_rate" in df.columns
