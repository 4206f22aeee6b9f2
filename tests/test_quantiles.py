"""Distributed exact quantiles equal pandas ``quantile`` bit for bit (and Spark's
single-merge ``percentile`` up to its interpolation formula)."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnlens.operators.quantiles import quantile_table, quartiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("n,distinct,parts", [(1, 1, 3), (2, 2, 3), (7, 3, 2), (1000, 10, 5), (3000, 3000, 8)])
def test_matches_percentile(spark, n, distinct, parts):
    rnd = random.Random(n * 31 + distinct)
    # a hot value holds a third of the rows
    values = [7.0 if i % 3 == 0 else float(rnd.randint(0, distinct)) / 4 for i in range(n)]
    rows = [(v, -v * 2 if i % 5 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r.column: r for r in quantile_table(df.repartition(parts), ["a", "b"], PROBS).collect()}
    for c, col in (("a", 0), ("b", 1)):
        s = pd.Series([r[col] for r in rows], dtype="float64")
        if s.count() == 0:
            assert c not in got
            continue
        values = [got[c][f"_q{i}"] for i in range(len(PROBS))]
        assert values == [float(s.quantile(p)) for p in PROBS]
        spark_pct = df.agg(F.percentile(c, F.array(*[F.lit(p) for p in PROBS]))).first()[0]
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(values, spark_pct))
        assert got[c].n == s.count()


def test_nan_and_null_skipped_like_pandas(spark):
    vals = [1.0, float("nan"), 3.0, None, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = quantile_table(df, ["x"], [0.25, 0.75]).first()
    clean = np.array([1.0, 3.0, 10.0])
    assert (q._q0, q._q1) == (float(np.quantile(clean, 0.25)), float(np.quantile(clean, 0.75)))


def test_empty_column_gives_null_quartiles(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    r = quartiles(df, "x").collect()
    assert len(r) == 1 and r[0].q1 is None and r[0].q3 is None


def test_methods_agree_on_small_data(spark):
    df = spark.range(0, 999).select((F.col("id") % 37 * 1.5).alias("x"))
    exact = quartiles(df, "x").first()
    single = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first().q
    approx = quartiles(df, "x", method="approx").first()
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(exact, single))
    assert all(math.isclose(a, b, abs_tol=1.5) for a, b in zip(exact, approx))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_outlier_shape_equals_filtered_count(spark, seed):
    from txnlens.operators.quantiles import outlier_shape, outliers, shape
    rnd = random.Random(seed)
    rows = [(float(rnd.choice([0, 1, 1, 2, 3, 50, -40])) if i % 9 else None, i) for i in range(800)]
    df = spark.createDataFrame(rows, "x double, i int")
    for side in ("low", "high"):
        assert tuple(outlier_shape(df, "x", side).first()) == \
            tuple(shape(outliers(df, "x", side)).first())


@pytest.mark.parametrize("n", [1, 2, 3, 9_999, 10_001, 60_000])
def test_quantiles_of_many_values(spark, n):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.lognormal(0, 4, n - n // 3), np.full(n // 3, 7.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    q = quantile_table(df, ["x"], PROBS).first()
    for i, p in enumerate(PROBS):
        assert q[f"_q{i}"] == float(np.quantile(values, p))
