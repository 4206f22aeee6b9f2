"""Every named query against its DuckDB SQL on the same parquet tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF_SMALL
from txnlens.plans.catalog import QUERIES
from txnlens.plans.verify import compare

TABLES = "region nation customer supplier part orders lineitem events labels".split()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_duckdb(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[key])
    verdict = compare(rows, df.columns, rel.fetchall(), rel.columns)
    assert verdict in ("exact", "close"), verdict


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["use_chip", "transaction_count", "avg_amount", "total_volume"]
    assert df.count() == 3
