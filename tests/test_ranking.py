"""Distributed row numbers and tiles equal the single-partition window functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnlens.operators.ranking import global_row_number, ntile


@pytest.mark.parametrize("n,tiles,parts", [(1, 5, 4), (4, 5, 3), (5, 5, 2), (103, 5, 7), (1000, 7, 8), (2000, 5, 1)])
def test_ntile_matches_window(spark, n, tiles, parts):
    rnd = random.Random(n)
    # many ties on the value: the client id breaks them
    rows = [(i, float(rnd.randint(0, 20))) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "client_id long, total double")
    order = [F.desc("total"), F.asc("client_id")]
    got = {r.client_id: r.t for r in ntile(df, order, tiles, "t", parts).collect()}
    want = {r.client_id: r.t for r in df.select(
        "client_id", F.ntile(tiles).over(Window.orderBy(*order)).alias("t")).collect()}
    assert got == want


def test_row_number_is_a_permutation(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = global_row_number(df, [F.asc("k")], "rn", 6).select("k", "rn").collect()
    assert sorted(r.rn for r in got) == list(range(1, 5001))
    assert all(r.rn == r.k + 1 for r in got)


def test_hot_value_is_split(spark):
    # a third of the rows share one total; their ranks still spread over partitions
    rows = [(i, 5.0 if i % 3 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "client_id long, total double")
    out = global_row_number(df, [F.desc("total"), F.asc("client_id")], "rn", 6)
    per_part = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in per_part) < 1500


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 6), min_size=1, max_size=300), st.integers(1, 9), st.integers(1, 7))
def test_ntile_property(spark, totals, tiles, parts):
    df = spark.createDataFrame([(i, float(t)) for i, t in enumerate(totals)], "client_id long, total double")
    order = [F.desc("total"), F.asc("client_id")]
    got = {r.client_id: r.t for r in ntile(df, order, tiles, "t", parts).collect()}
    want = {r.client_id: r.t for r in df.select(
        "client_id", F.ntile(tiles).over(Window.orderBy(*order)).alias("t")).collect()}
    assert got == want


from txnlens.operators.ranking import tiles_by_rank  # noqa: E402


def _tiles(spark, rows, tiles):
    df = spark.createDataFrame(rows, "client_id long, total double").repartition(3)
    order = [F.desc("total"), F.asc("client_id")]
    want = {r.client_id: r.t for r in df.select("client_id", F.ntile(tiles).over(Window.orderBy(*order)).alias("t")).collect()}
    return {r.client_id: r.t for r in tiles_by_rank(df, "total", "client_id", tiles, "t").collect()}, want


@pytest.mark.parametrize("n,tiles", [(0, 5), (1, 5), (4, 5), (5, 5), (103, 5), (1000, 7), (50, 1)])
def test_tiles_by_rank_match_the_window(spark, n, tiles):
    rnd = random.Random(n)
    got, want = _tiles(spark, [(i * 37 - 400, float(rnd.randint(-9, 9)) / 4) for i in range(n)], tiles)
    assert got == want


def test_tiles_of_one_value_and_of_odd_values(spark):
    one = [(i * 10**9, 0.0) for i in range(500)]
    assert (lambda p: p[0] == p[1])(_tiles(spark, one, 5))
    odd = [(0, float("nan")), (1, float("inf")), (2, -float("inf")), (3, 1e308), (4, -0.0), (5, 0.0), (6, 1e-300), (7, -1e-300), (2**62, 1.0), (-2**62, 1.0)]
    got, want = _tiles(spark, [r for r in odd if r[0]], 4)
    assert got == want
    assert _tiles(spark, odd[:1] + odd[2:], 3)[0][0] == 1  # NaN counts as the largest
