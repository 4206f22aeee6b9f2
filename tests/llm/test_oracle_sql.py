"""The operators that SQL can express, against DuckDB."""

import duckdb
import pytest
from llm_inputs import SF_SMALL

from txnlens.llm.queries import ORACLE_SQL, QUERIES
from txnlens.plans.verify import compare


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_duckdb(spark, key):
    duck = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    df = QUERIES[key](spark, SF_SMALL)
    rel = duck.sql(ORACLE_SQL[key])
    assert compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), rel.columns) == "exact"


def test_queries_name_every_operator_once():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
