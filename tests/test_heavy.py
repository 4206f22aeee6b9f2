"""Top-k reports by bounded summaries against the plain reports."""

import random

import pytest

from txnlens.operators import aggregates as agg
from txnlens.operators.heavy import bounds, heavy_customers, heavy_keys, heavy_places, heavy_spenders

SCHEMA = "id long, client_id long, merchant_city string, amount double"

BOUNDED = [{}, {"buckets": 1}, {"buckets": 40, "pilots": 3}]


def same(got, want):
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert repr(got.collect()) == repr(want.collect())


@pytest.fixture(scope="module")
def txn(spark):
    r = random.Random(8)
    rows = []
    for i in range(3000):
        client = r.choice([None, 1, 1, 2, r.randrange(300), r.randrange(300)])
        amount = r.choice([None, -500.25, 0.1, 12.34, 12.34, r.randrange(-9000, 90000) / 100])
        rows.append((i, client, r.choice([None, "ONLINE", f"c{r.randrange(200)}"]), amount))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bounded", BOUNDED, ids=str)
def test_equal_to_the_plain_reports(txn, bounded):
    for n in (1, 60):
        same(heavy_spenders(txn, n, **bounded), agg.top_spenders(txn, n))
        same(heavy_customers(txn, n, **bounded), agg.most_active_customers(txn, n))
        same(heavy_places(txn, "merchant_city", n, **bounded), agg.top_places(txn, "merchant_city", n))


@pytest.mark.parametrize("amounts", [
    [-1.0, -2.0, -3.0, None], [5.0] * 4, [None] * 4, [1e300, 1e300, 1.0, -1e300], [float("inf"), 1.0, float("nan"), -float("inf")],
    [1e10, 0.1, 1e10 + 0.5, 3.0], [0.0, -0.0, 0.0, 0.0]], ids=str)
def test_negative_equal_missing_and_large_totals(spark, amounts):
    """Totals below zero, ties, no values, and values that are summed as doubles."""
    rows = [(i, i % 9, "x", amounts[i % len(amounts)]) for i in range(72)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (4, 20):
        same(heavy_spenders(df, n, buckets=16, pilots=1), agg.top_spenders(df, n))
        same(heavy_customers(df, n, buckets=16, pilots=1), agg.most_active_customers(df, n))


def test_no_rows(txn):
    none = txn.limit(0)
    assert heavy_spenders(none).collect() == [] and heavy_customers(none).collect() == []
    assert heavy_customers(txn.filter("client_id is null")).collect() == []


def test_a_bucket_bounds_each_of_its_keys(txn):
    from pyspark.sql import functions as F

    by_bucket = {r[0]: r["bound"] for r in bounds(txn.filter("client_id is not null"), "client_id", "amount", 11).collect()}
    for r in agg.customer_summary(txn).withColumn("b", F.pmod(F.xxhash64("client_id"), F.lit(11))).collect():
        assert r["total_spent"] <= by_bucket[r["b"]]


def test_few_keys_remain_where_few_are_heavy(spark):
    """200,000 customers of one transaction each and five heavy ones: the last step totals few of them."""
    light = spark.range(200_000).selectExpr("id", "id + 1000 AS client_id", "'x' AS merchant_city", "1.0D AS amount")
    heavy = spark.range(5000).selectExpr("id", "id % 5 AS client_id", "'x' AS merchant_city", "100.0D AS amount")
    df = light.unionByName(heavy)
    got = heavy_spenders(df, 5)
    rows = got.collect()
    assert [r["client_id"] for r in rows] == [0, 1, 2, 3, 4]
    # five buckets hold the heavy customers; the others hold about three light ones each
    sums = bounds(df, "client_id", "amount")
    assert sums.filter(f"bound >= {rows[-1]['total_spent']}").count() == 5


def test_arguments(txn):
    with pytest.raises(ValueError):
        heavy_keys(txn, "client_id", [], "x", 5, value="amount", counted="amount")
    with pytest.raises(ValueError):
        heavy_spenders(txn, 0)
