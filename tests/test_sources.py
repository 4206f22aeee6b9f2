"""Round trips through the file readers, staging and the streaming reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from txnlens.operators import aggregates as agg
from txnlens.operators.cleaning import clean_transactions, clean_users
from txnlens.operators.features import txn_features
from txnlens.plans import catalog as C
from txnlens.plans.verify import compare
from txnlens.sources import adapters
from txnlens.schemas import MCC
from txnlens.sources.files import (parse_failures, read_cards, read_label_map, read_mcc, read_transactions, read_typed_csv,
                                   read_users)
from txnlens.sources.staging import stage
from txnlens.streaming.reports import channel_volume, hourly_error_rates, read_transaction_stream, start_report


def _same(a, b):
    return compare([tuple(r) for r in a.collect()], a.columns, [tuple(r) for r in b.collect()], b.columns)


def _csv(df, path):
    (df.write.option("header", True).option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return path


def test_transactions_csv_round_trip(spark, tmp_dir):
    raw = adapters.txn_raw(spark, SF_SMALL)
    back = read_transactions(spark, _csv(raw, os.path.join(tmp_dir, "txn")))
    assert _same(clean_transactions(back), clean_transactions(raw)) == "exact"


def test_users_cards_mcc_csv_round_trip(spark, tmp_dir):
    users = adapters.users_raw(spark, SF_SMALL)
    assert _same(clean_users(read_users(spark, _csv(users, os.path.join(tmp_dir, "u")))), clean_users(users)) == "exact"
    cards = adapters.cards(spark, SF_SMALL)
    assert _same(read_cards(spark, _csv(cards, os.path.join(tmp_dir, "c"))), cards) == "exact"
    mcc = adapters.mcc_codes(spark, SF_SMALL)
    assert _same(read_mcc(spark, _csv(mcc, os.path.join(tmp_dir, "m"))), mcc) == "exact"


def test_cards_with_month_year_dates(spark, tmp_dir):
    path = os.path.join(tmp_dir, "cards.csv")
    with open(path, "w") as f:
        f.write("id,client_id,acct_open_date,expires,has_chip,card_type,card_on_dark_web\n"
                "1,7,09/2002,12/2022,YES,Debit,No\n2,7,bad,12/2022,NO,Credit,Yes\n")
    rows = read_cards(spark, path, date_format="MM/yyyy").orderBy("id").collect()
    assert str(rows[0].acct_open_date) == "2002-09-01 00:00:00" and rows[1].acct_open_date is None


def test_label_json_round_trip(spark, tmp_dir):
    labels = adapters.fraud_labels(spark, SF_SMALL)
    mapping = {str(r.id): r.Target for r in labels.collect()}  # small fixture file
    path = os.path.join(tmp_dir, "fraud_labels.json")
    with open(path, "w") as f:
        json.dump({"target": mapping}, f)
    assert _same(read_label_map(spark, path), labels) == "exact"


def test_staging_partitions_by_year(spark):
    txn = C.transactions(spark, SF_SMALL)
    staged = stage(txn, partition_by=["year"])
    assert _same(agg.txn_by_year(staged), agg.txn_by_year(txn)) == "exact"
    plan = staged.filter(F.col("year") == 2020)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan


def test_streaming_reports_match_batch(spark, tmp_dir):
    raw = adapters.txn_raw(spark, SF_SMALL)
    folder = os.path.join(tmp_dir, "incoming")
    for i, part in enumerate(raw.randomSplit([0.5, 0.5], seed=1)):
        _csv(part, os.path.join(folder, f"batch{i}"))
    stream = read_transaction_stream(spark, os.path.join(folder, "*"), columns=raw.columns)
    q1 = start_report(hourly_error_rates(stream), "hourly_errors", os.path.join(tmp_dir, "ck1"), available_now=True)
    q2 = start_report(channel_volume(stream), "channel_volume", os.path.join(tmp_dir, "ck2"), available_now=True)
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    batch = txn_features(clean_transactions(raw))
    assert _same(spark.table("hourly_errors"), hourly_error_rates(batch)) == "exact"
    assert _same(spark.table("channel_volume"), channel_volume(batch)) == "exact"


def test_staging_with_salted_layout(spark):
    txn = C.transactions(spark, SF_SMALL)
    staged = stage(txn, partition_by=["year"], files_per_value=3)
    assert _same(agg.txn_by_year(staged), agg.txn_by_year(txn)) == "exact"
    assert staged.count() == txn.count()


def test_streaming_resumes_from_checkpoint(spark, tmp_dir):
    raw = adapters.txn_raw(spark, SF_SMALL)
    first, second = raw.randomSplit([0.5, 0.5], seed=7)
    folder = os.path.join(tmp_dir, "arriving")
    checkpoint = os.path.join(tmp_dir, "stream-state")
    _csv(first, os.path.join(folder, "a"))
    stream = read_transaction_stream(spark, os.path.join(folder, "*"), columns=raw.columns)
    q = start_report(hourly_error_rates(stream), "hourly_resume", checkpoint=checkpoint, available_now=True)
    q.awaitTermination(120)
    # new files arrive while the query is stopped; a restart picks up only those
    _csv(second, os.path.join(folder, "b"))
    stream = read_transaction_stream(spark, os.path.join(folder, "*"), columns=raw.columns)
    q = start_report(hourly_error_rates(stream), "hourly_resume", checkpoint=checkpoint, available_now=True)
    q.awaitTermination(120)
    batch = hourly_error_rates(txn_features(clean_transactions(raw)))
    assert _same(spark.table("hourly_resume"), batch) == "exact"


def test_readers_rename_source_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "mcc.csv")
    with open(path, "w") as f:
        f.write("mcc_code,label\n5411,Grocery Stores\n5812,Restaurants\n")
    df = read_mcc(spark, path, rename={"mcc_code": "code", "label": "description"})
    assert df.dtypes == [("code", "int"), ("description", "string")]
    assert {r.code: r.description for r in df.collect()} == {5411: "Grocery Stores", 5812: "Restaurants"}


def _file(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_files_with_other_column_orders(spark, tmp_dir):
    _file(tmp_dir, "a.csv", "code,description\n1,one\n2,two\n")
    _file(tmp_dir, "b.csv", "description,code\nthree,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_mcc(spark, tmp_dir).collect()
    got = {(r.code, r.description) for r in read_mcc(spark, tmp_dir, by_header=True).collect()}
    assert got == {(1, "one"), (2, "two"), (3, "three")}


def test_malformed_lines_are_counted_and_raise_under_strict(spark, tmp_dir):
    path = _file(tmp_dir, "m.csv", 'code,description\n1,one,EXTRA\n2\n3,"line\nbreak"\n4,four\n')
    got = {r.column: r.failures for r in parse_failures(spark, path, MCC).collect()}
    assert got["(line)"] >= 3 and got["code"] == 1
    assert {r.code for r in read_mcc(spark, path).collect()} >= {1, 2, 4}
    with pytest.raises(Exception, match="malformed line"):
        read_typed_csv(spark, path, MCC, strict=True).select("description").collect()
    good = _file(tmp_dir, "g.csv", "code,description\n4,four\n")
    assert [tuple(r) for r in read_typed_csv(spark, good, MCC, strict=True).collect()] == [(4, "four")]


def test_label_objects(spark, tmp_dir):
    empty = _file(tmp_dir, "e.json", '{"target": {}}\n')
    assert read_label_map(spark, empty).collect() == []
    escaped = _file(tmp_dir, "x.json", '{"target": {"1": "\\u0059es", "2": "a\\"b", "3": null, "4": 1}}')
    for whole in (False, True):
        assert {r.id: r.Target for r in read_label_map(spark, escaped, whole).collect()} == {1: "Yes", 2: 'a"b', 3: None, 4: "1"}
    comma = _file(tmp_dir, "c.json", '{"target": {"1": "a, b", "2": "No"}}')
    with pytest.raises(Exception, match="not an id/label pair"):
        read_label_map(spark, comma).collect()
    assert {r.id: r.Target for r in read_label_map(spark, comma, whole=True).collect()} == {1: "a, b", 2: "No"}
