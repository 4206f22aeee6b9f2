"""Values computed independently (FIXTURES.md section 4) for sf0.01."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from txnlens.plans import catalog as C
from txnlens.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def txn(spark):
    df = C.transactions(spark, SF_CHECK).cache()
    yield df
    df.unpersist()


def test_amount_parsing_and_flags(txn):
    r = txn.agg(F.count("amount").alias("n"), F.sum("is_refund").alias("refunds"),
                F.sum("is_high_value").alias("high")).first()
    assert (r.n, r.refunds, r.high) == (9811, 892, 58)


def test_outlier_counts(spark):
    low = QUERIES["amount_low_outliers"](spark, SF_CHECK).first()
    high = QUERIES["amount_high_outliers"](spark, SF_CHECK).first()
    assert (low.rows, high.rows) == (52, 446)
    assert low.columns == 18


def test_channel_counts(spark):
    got = {r.use_chip: r.transaction_count for r in QUERIES["txn_by_channel"](spark, SF_CHECK).collect()}
    assert got == {"Chip Transaction": 3270, "Online Transaction": 3270, "Swipe Transaction": 3271}


def test_error_counts(spark):
    got = {r.errors: r["count"] for r in QUERIES["error_types"](spark, SF_CHECK).collect()}
    assert got == {"Bad CVV": 508, "Bad PIN": 501, "Technical Glitch": 489, "Insufficient Balance": 470}


def test_users(spark):
    u = C.users(spark, SF_CHECK)
    assert {r.is_retired: r.n for r in u.groupBy("is_retired").agg(F.count("*").alias("n")).collect()} == {0: 1016, 1: 484}
    assert QUERIES["income_high_outliers"](spark, SF_CHECK).count() == 14
    assert u.filter(F.col("yearly_income") == 0).count() == 16
    assert u.filter(F.col("credit_score") == 300).count() == 3


def test_cards(spark):
    k = C.cards(spark, SF_CHECK)
    r = k.agg(F.min("account_duration_days").alias("lo"), F.max("account_duration_days").alias("hi"),
              F.sum("is_chip_enabled").alias("chip"), F.count("*").alias("n")).first()
    assert (r.lo, r.hi, r.chip, r.n) == (-362, 5874, 4800, 6000)


def test_labels(spark):
    got = {r.Target: r["count"] for r in QUERIES["label_counts"](spark, SF_CHECK).collect()}
    assert got == {"No": 7584, "Yes": 416}


def test_dark_web(spark):
    got = {r.card_on_dark_web: (r.transactions, r.errors)
           for r in QUERIES["dark_web_cards"](spark, SF_CHECK).collect()}
    assert got == {"No": (7612, 1553), "Yes": (388, 87)}
    assert tuple(QUERIES["unmatched_card_transactions"](spark, SF_CHECK).first()) == (150, 2000)


def test_described_jobs(spark, txn):
    per_client = txn.filter("client_id is not null").groupBy("client_id").count()
    assert per_client.filter("count >= 50").count() == 149
    assert QUERIES["refund_customers"](spark, SF_CHECK).count() == 2
    bands = {r.risk_band: r.customers for r in QUERIES["risk_band_counts"](spark, SF_CHECK).collect()}
    assert bands == {"High": 167, "Medium": 702, "Low": 631}
    unknown = QUERIES["merchant_categories"](spark, SF_CHECK).filter("description = 'Unknown'")
    assert unknown.agg(F.sum("transactions")).first()[0] == 2500
    assert QUERIES["income_low_outliers"](spark, SF_CHECK).count() == 14
    assert {r.use_chip for r in QUERIES["fraud_by_channel"](spark, SF_CHECK).collect()} == {
        "Chip Transaction", "Online Transaction", "Swipe Transaction"}
