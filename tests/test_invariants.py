"""Properties that must hold on the adapter tables whatever the scale."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from txnlens.operators import quantiles
from txnlens.plans import catalog as C
from txnlens.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def txn(spark):
    df = C.transactions(spark, SF_SMALL).cache()
    yield df
    df.unpersist()


def test_cleaning_leaves_no_nulls(spark):
    nulls = {(r.table, r.column): r.null_count for r in QUERIES["null_counts"](spark, SF_SMALL).collect()}
    for col in ("merchant_state", "errors", "zip"):
        assert nulls[("transactions", col)] == 0


def test_shares_sum_to_one(spark):
    for key, col in (("label_shares", "proportion"), ("channel_mix_by_year", "share"),
                     ("geography", "share"), ("error_rate_by_type", "share_of_errors")):
        df = QUERIES[key](spark, SF_SMALL)
        if key == "channel_mix_by_year":
            sums = [r.s for r in df.groupBy("year").agg(F.sum(col).alias("s")).collect()]
        else:
            sums = [df.agg(F.sum(col)).first()[0]]
        assert all(s == pytest.approx(1.0) for s in sums), key


def test_bands_cover_all_users(spark):
    users = C.users(spark, SF_SMALL)
    banded = QUERIES["credit_bands"](spark, SF_SMALL).agg(F.sum("count")).first()[0]
    unbanded = users.filter((F.col("credit_score") <= 300) | (F.col("credit_score") > 850)).count()
    assert banded + unbanded == users.count()


def test_outliers_partition_amounts(spark, txn):
    low = quantiles.outliers(txn, "amount", "low").count()
    high = quantiles.outliers(txn, "amount", "high").count()
    b = quantiles.iqr_bounds(txn, "amount").first()
    inside = txn.filter((F.col("amount") >= b.lb) & (F.col("amount") <= b.ub)).count()
    assert low + inside + high == txn.filter(F.col("amount").isNotNull()).count()


def test_groupings_add_up(spark, txn):
    n = QUERIES["overview"](spark, SF_SMALL).first().transactions
    assert n == txn.count()
    assert QUERIES["error_rate_by_hour"](spark, SF_SMALL).agg(F.sum("transactions")).first()[0] == n
    assert QUERIES["chip_vs_swipe_errors"](spark, SF_SMALL).agg(F.sum("transactions")).first()[0] == n
    total = QUERIES["refund_summary"](spark, SF_SMALL).filter("is_total = 1").first()
    assert total.transactions == n
    assert QUERIES["channel_mix_wide"](spark, SF_SMALL).select(
        F.sum(F.col("chip") + F.col("online") + F.col("swipe") + F.col("other"))).first()[0] == n
    tiers = QUERIES["tier_summary"](spark, SF_SMALL).agg(F.sum("customers")).first()[0]
    assert tiers == txn.filter("client_id is not null").select("client_id").distinct().count()


def test_correlation_symmetric_unit_diagonal(spark):
    m = {(r.column_a, r.column_b): r.r for r in QUERIES["user_correlations"](spark, SF_SMALL).collect()}
    for (a, b), r in m.items():
        assert r == m[(b, a)]
        if a == b:
            assert r == 1.0


def test_approximate_overview_is_close(spark, txn):
    from txnlens.operators import risk
    exact = risk.overview(txn).first()
    approx = risk.overview(txn, approx=True).first()
    assert approx.transactions == exact.transactions
    for c in ("customers", "cards", "merchants"):
        assert abs(approx[c] - exact[c]) <= max(2, 0.05 * exact[c])


def test_approximate_distinct_options_are_close(spark, txn):
    from txnlens.operators import risk
    for report, col in ((risk.revenue_growth, "customers"), (risk.geography, "merchants")):
        key = "year" if report is risk.revenue_growth else "merchant_state"
        exact = {r[key]: r[col] for r in report(txn).collect()}
        approx = {r[key]: r[col] for r in report(txn, approx=True).collect()}
        assert exact.keys() == approx.keys()
        assert all(abs(approx[k] - exact[k]) <= max(2, 0.05 * exact[k]) for k in exact)
