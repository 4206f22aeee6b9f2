"""Literal-row tests for the places where the obvious Spark call differs from pandas."""

import datetime as dt
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from txnlens.functions.dates import whole_days
from txnlens.functions.nulls import null_na_strings
from txnlens.functions.numeric import (
    money_avg, money_sum, round_half_even, safe_ratio, strip_currency, to_number,
)
from txnlens.operators import aggregates as agg
from txnlens.operators.binning import band_label, cut_counts
from txnlens.operators.cleaning import clean_transactions, clean_users
from txnlens.operators.correlation import correlation_matrix
from txnlens.operators.features import txn_features, user_features
from txnlens.operators.profile import describe, duplicate_rows
from txnlens.schemas import TXN
from txnlens.sources.files import parse_failures, read_label_map, read_transactions

HEADER = "id,date,client_id,card_id,amount,use_chip,merchant_city,merchant_state,zip,merchant_id,mcc,errors"


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_t1_pandas_missing_markers(spark):
    df = spark.createDataFrame([(s,) for s in ["NA", "None", "n/a", "x", "null", "NaN", "#N/A", "ok"]], "v string")
    got = [r.v for r in null_na_strings(df).collect()]
    assert got == [None, None, None, "x", None, None, None, "ok"]


def test_t1_t6_csv_markers_are_filled(spark, tmp_dir):
    path = _write(tmp_dir, "t.csv", HEADER + "\n"
                  "1,2015-01-01 10:00:00,5,50,$1.00,Chip Transaction,Austin,NA,78701,9,5411,None\n"
                  "2,2015-01-01 11:00:00,5,50,10.5,Online Transaction,ONLINE,,,9,5411,Bad PIN\n")
    t = clean_transactions(read_transactions(spark, path)).orderBy("id").collect()
    assert [r.merchant_state for r in t] == ["ONLINE", "ONLINE"]
    assert [r.errors for r in t] == ["No Errors", "Bad PIN"]
    assert [r.zip for r in t] == [78701.0, 0.0]
    # the reference strips "$" only from user money columns
    assert [r.amount for r in t] == [None, 10.5]


def test_t2_bad_date_and_quoted_comma(spark, tmp_dir):
    path = _write(tmp_dir, "t.csv", HEADER + "\n"
                  '1,not a date,5,50,3.5,Chip Transaction,"Main St, ""Apt"" 5",TX,1,9,5411,\n'
                  "2,2016-02-29 23:59:59,5,50,4.5,Chip Transaction,Austin,TX,1,9,5411,\n")
    rows = read_transactions(spark, path).orderBy("id").collect()
    assert rows[0].date is None
    assert rows[0].merchant_city == 'Main St, "Apt" 5'
    assert rows[1].date == dt.datetime(2016, 2, 29, 23, 59, 59)
    with pytest.raises(Exception):
        read_transactions(spark, path, strict=True).collect()


def test_t3_label_map(spark, tmp_dir):
    labels = {str(i): ("Yes" if i % 7 == 0 else "No") for i in range(1000)}
    compact = _write(tmp_dir, "labels.json", json.dumps({"target": labels}))
    pretty = _write(tmp_dir, "labels_pretty.json", json.dumps({"target": labels}, indent=2))
    for path in (compact, pretty):
        df = read_label_map(spark, path)
        assert df.dtypes == [("id", "bigint"), ("Target", "string")]
        got = {r.id: r.Target for r in df.collect()}
        assert got == {int(k): v for k, v in labels.items()}
    bad = _write(tmp_dir, "bad.json", '{"target": {"1": "No", garbage, "2": "Yes"}}')
    with pytest.raises(Exception):
        read_label_map(spark, bad).collect()


def test_t4_describe_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (10.0,)], "x double")
    r = describe(df, ["x"]).first()
    assert (r.p25, r.p50, r.p75) == (2.0, 3.0, 6.5)
    assert r["count"] == 3 and r.min == 1.0 and r.max == 10.0
    assert r.mean == pytest.approx(14 / 3)
    assert r.std == pytest.approx(float(np.std([1, 3, 10], ddof=1)), abs=1e-9)


@pytest.mark.parametrize("text,expected", [
    ("12.5", 12.5), (" 7 ", 7.0), ("-3", -3.0), ("+4", 4.0), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0),
    ("1.0d", None), ("1_000", None), ("inf", None), ("1e400", None), ("$12.5", None), ("abc", None),
    ("NaN", None), ("Infinity", None), ("0x10", None), (None, None), ("", None),
])
def test_t5_to_number(spark, text, expected):
    got = spark.createDataFrame([(text,)], "s string").select(to_number("s").alias("v")).first().v
    assert got == expected


def test_t5_strip_currency(spark):
    df = spark.createDataFrame([("$1,5",)], "s string")
    with pytest.raises(Exception):
        df.select(strip_currency("s")).collect()
    ok = spark.createDataFrame([("$12.50",), (None,), ("$-3",)], "s string")
    assert [r.v for r in ok.select(strip_currency("s").alias("v")).collect()] == [12.5, None, -3.0]


def test_t7_flags_are_zero_for_null(spark):
    df = spark.createDataFrame([Row(date=dt.datetime(2015, 3, 1, 4, 5), amount=None, merchant_city=None,
                                    merchant_state=None, zip=None, errors=None)],
                               "date timestamp_ntz, amount string, merchant_city string, merchant_state string, "
                               "zip double, errors string")
    r = txn_features(clean_transactions(df)).first()
    assert (r.is_online, r.is_refund, r.is_high_value) == (0, 0, 0)
    assert (r.year, r.month, r.hour) == (2015, 3, 4)


def test_t8_clip_keeps_null(spark):
    df = spark.createDataFrame([(70, 60), (None, 60), (30, 65)], "current_age int, retirement_age int")
    df = df.withColumns({"total_debt": F.lit(1.0), "yearly_income": F.lit(2.0)})
    got = [(r.years_to_retirement, r.is_retired) for r in user_features(df).collect()]
    assert got == [(0, 1), (None, 0), (35, 0)]


def test_t9_division_like_floats(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (6.0, 3.0)],
                               "x double, y double")
    got = [r.v for r in df.select(safe_ratio("x", "y").alias("v")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert got[3] is None and got[4] is None and got[5] == 2.0


def test_t10_rounding_matches_numpy(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.uniform(-10, 10, 3000), np.arange(-500, 500) / 200.0 + 0.005,
                             np.arange(0, 200) / 8.0])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r.v for r in df.select(round_half_even("x", 2).alias("v")).collect()]
    assert got == [float(np.round(v, 2)) for v in values]


def test_t11_whole_days_floor(spark):
    df = spark.createDataFrame([
        (dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 2, 1)),
        (dt.datetime(2020, 1, 2, 1), dt.datetime(2020, 1, 1, 23)),
        (dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 1)),
    ], "a timestamp_ntz, b timestamp_ntz")
    assert [r.d for r in df.select(whole_days("a", "b").alias("d")).collect()] == [0, -1, 60]


def test_t12_null_keys_and_all_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5.0), ("b", 2.0)], "use_chip string, amount double")
    got = {r.use_chip: (r.transaction_count, r.avg_amount, r.total_volume) for r in agg.txn_by_channel(df).collect()}
    assert got == {"a": (0, None, 0.0), "b": (1, 2.0, 2.0)}


def test_t13_right_closed_bins(spark):
    df = spark.createDataFrame([(s,) for s in [300, 301, 579, 580, 850, 851, None]], "credit_score int")
    labels = [r.b for r in df.select(band_label("credit_score").alias("b")).collect()]
    assert labels == [None, "Poor", "Poor", "Fair", "Exceptional", None, None]
    counts = [(r.band, r["count"]) for r in cut_counts(df, "credit_score").collect()]
    assert counts == [("Poor", 2), ("Fair", 1), ("Good", 0), ("Very Good", 0), ("Exceptional", 1)]


def test_t14_constant_column_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, None), (3.0, 5.0, 7.0), (4.0, 5.0, 1.0)],
                               "a double, c double, b double")
    m = {(r.column_a, r.column_b): r.r for r in correlation_matrix(df, ["a", "c", "b"]).collect()}
    assert m[("a", "c")] is None and m[("c", "c")] is None
    assert m[("a", "a")] == pytest.approx(1.0)
    rows = [(1.0, 2.0), (3.0, 7.0), (4.0, 1.0)]
    expected = float(np.corrcoef(np.array(rows).T)[0, 1])
    assert m[("a", "b")] == pytest.approx(expected, abs=1e-9)
    assert m[("a", "b")] == m[("b", "a")]


def test_t15_money_sum_is_partition_independent(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(round(v, 2)),) for v in rng.uniform(-1000, 1000, 5000)], "amount double")
    one = df.coalesce(1).agg(money_sum("amount")).first()[0]
    many = df.repartition(13).agg(money_sum("amount")).first()[0]
    assert one == many


def test_t16_csv_columns_by_name(spark, tmp_dir):
    cols = HEADER.split(",")
    shuffled = list(reversed(cols))
    row = {"id": "1", "date": "2015-01-01 00:00:00", "client_id": "5", "card_id": "50", "amount": "3.5",
           "use_chip": "Chip Transaction", "merchant_city": "Austin", "merchant_state": "TX", "zip": "78701",
           "merchant_id": "9", "mcc": "5411", "errors": ""}
    path = _write(tmp_dir, "t.csv", ",".join(shuffled) + "\n" + ",".join(row[c] for c in shuffled) + "\n")
    r = read_transactions(spark, path).first()
    assert (r.id, r.client_id, r.merchant_city, r.zip, r.mcc) == (1, 5, "Austin", 78701.0, 5411)


def test_duplicates_count_null_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    assert duplicate_rows(df, "t").first().duplicates == 2


def test_users_money_columns(spark):
    df = spark.createDataFrame([("$100", "$2000", "$0")], "per_capita_income string, yearly_income string, total_debt string")
    r = clean_users(df).first()
    assert (r.per_capita_income, r.yearly_income, r.total_debt) == (100.0, 2000.0, 0.0)


def test_money_sums_equal_decimal_sums(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([np.round(rng.uniform(-1e4, 1e4, 4000), 2), np.round(rng.uniform(-50, 50, 4000), 6),
                           np.round(rng.uniform(-1e9, 1e9, 500), 3), [0.005, -0.005, 0.000001, 123.4565]])
    df = spark.createDataFrame([(float(v), i % 7) for i, v in enumerate(vals)], "amount double, g int")
    got = {r.g: (r.s, r.a) for r in df.groupBy("g").agg(money_sum("amount").alias("s"),
                                                          money_avg("amount").alias("a")).collect()}
    dec = F.col("amount").cast("decimal(24,6)")
    want = {r.g: (r.s, r.a) for r in df.groupBy("g").agg(
        F.sum(dec).cast("double").alias("s"), (F.sum(dec).cast("double") / F.count("amount")).alias("a")).collect()}
    assert got == want


def test_t3_label_map_bare_literals(spark, tmp_dir):
    path = _write(tmp_dir, "bare.json", '{"target": {"1": 0, "2": 1, "3": null, "4": true, "5": "Yes"}}\n')
    got = {r.id: r.Target for r in read_label_map(spark, path).collect()}
    assert got == {1: "0", 2: "1", 3: None, 4: "true", 5: "Yes"}


def test_t2_bad_values_are_counted(spark, tmp_dir):
    path = _write(tmp_dir, "t.csv", HEADER + "\n"
                  "1,not a date,5,50,3.5,Chip Transaction,Austin,TX,1,9,5411,\n"
                  "2,2016-02-29 23:59:59,x5,50,4.5,Chip Transaction,Austin,TX,NA,9,5411,\n"
                  "3,,5,50,4.5,Chip Transaction,Austin,TX,1,9,5411,\n")
    got = {r.column: r.failures for r in parse_failures(spark, path, TXN).collect()}
    # an empty or NA field is missing, not a failure
    assert got["date"] == 1 and got["client_id"] == 1 and got["zip"] == 0 and got["id"] == 0


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_money_sums_have_no_ceiling(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        groups = {0: [1.0, 1e20], 1: [1e300, -1e300, 2.5], 2: [9e16, 9e16, 0.25], 3: [1.5e308, 1.5e308], 4: [0.1, 0.2, None],
                  5: [9999999999.99] * 3, 6: [None], 7: [float("nan"), 1.0]}
        rows = [(g, v) for g, vs in groups.items() for v in vs]
        got = {r.g: (r.s, r.a) for r in spark.createDataFrame(rows, "g int, amount double").repartition(3).groupBy("g").agg(
            money_sum("amount").alias("s"), money_avg("amount").alias("a")).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got[0] == (1e20 + 1.0, (1e20 + 1.0) / 2) and got[1][0] == 2.5 and got[2][0] == 1.8e17
    assert got[3][0] == float("inf") and got[4] == (0.3, 0.15) and got[5] == (29999999999.97, 9999999999.99)
    assert got[6] == (0.0, None) and np.isnan(got[7][0])


def test_rows_without_a_customer_are_nobodys(spark):
    from txnlens.operators.risk import customer_tiers, high_risk_customers, refund_customers
    rows = [(None if i % 2 else i % 6, 1.0 + i, "Bad PIN" if i % 2 else "No Errors", int(i % 2)) for i in range(60)]
    txn = spark.createDataFrame(rows, "client_id long, amount double, errors string, is_refund int")
    for out in (customer_tiers(txn), high_risk_customers(txn, 1), refund_customers(txn, 1, 0.1)):
        assert None not in {r.client_id for r in out.collect()}
    assert customer_tiers(txn).count() == 3


def test_channel_mix_wide_adds_up(spark):
    from txnlens.operators.risk import channel_mix_wide
    txn = spark.createDataFrame([(2019, "Chip Transaction"), (2019, "Contactless"), (2019, None), (2018, "Swipe Transaction")],
                                "year int, use_chip string")
    assert [tuple(r) for r in channel_mix_wide(txn).collect()] == [(2018, 0, 0, 1, 0), (2019, 1, 0, 0, 2)]
    with pytest.raises(ValueError):
        channel_mix_wide(txn, ("Chip A", "Chip B"))


def test_null_labels_are_not_labelled(spark):
    from txnlens.operators.risk import fraud_by_channel
    labels = spark.createDataFrame([(1, "Yes"), (2, None), (3, "No")], "id long, Target string")
    txn = spark.createDataFrame([(i, "Chip Transaction", 2019) for i in (1, 2, 3)], "id long, use_chip string, year int")
    assert [tuple(r) for r in fraud_by_channel(labels, txn).collect()] == [("Chip Transaction", 2019, 2, 1, 0.5)]


def test_nan_is_missing_for_outliers_and_correlation(spark):
    from txnlens.operators.quantiles import outliers
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 100, float("nan")], "b": [2.0, 1, float("nan"), 4, 5, 6]})
    df = spark.createDataFrame([tuple(map(float, r)) for r in pdf.itertuples(index=False)], "a double, b double")
    assert [r.a for r in outliers(df, "a", "high").collect()] == [100.0]
    m = {(r.column_a, r.column_b): r.r for r in correlation_matrix(df, ["a", "b"]).collect()}
    assert m["a", "b"] == pytest.approx(pdf.corr().loc["a", "b"])


@pytest.mark.parametrize("scale", [1e-10, 1.0, 1e12])
def test_describe_keeps_relative_precision(spark, scale):
    pdf = pd.DataFrame({"x": [1 * scale, 3 * scale, 2000 * scale, 7.25 * scale]})
    r = describe(spark.createDataFrame([(float(v),) for v in pdf.x], "x double"), ["x"]).first()
    assert r["mean"] == pytest.approx(pdf.x.mean(), rel=1e-9) and r["std"] == pytest.approx(pdf.x.std(), rel=1e-9)


def test_scores_below_the_bands_are_poor(spark):
    from txnlens.operators.risk import customer_risk
    users = spark.createDataFrame([(1, 300), (2, None), (3, 800)], "id long, credit_score int")
    txn = spark.createDataFrame([(1, "No Errors"), (2, "No Errors")], "client_id long, errors string")
    cards = spark.createDataFrame([(1, "No")], "client_id long, card_on_dark_web string")
    got = {r.client_id: (r.credit_band, r.risk_score) for r in customer_risk(users, txn, cards).collect()}
    assert got == {1: ("Poor", 3), 2: ("Unknown", 0), 3: ("Exceptional", 0)}
