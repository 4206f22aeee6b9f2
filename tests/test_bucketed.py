"""Tables staged by id: joins without an exchange, equal rows."""

import uuid

import pytest

from conftest import SF_SMALL
from test_plans import plan
from txnlens.analysis import FraudAnalysis
from txnlens.operators import risk
from txnlens.plans.catalog import benchmark_tables
from txnlens.plans.tables import Tables
from txnlens.sources.staging import read_by_id, stage_by_id


@pytest.fixture()
def no_broadcast(spark):
    """Tables as large as at scale: no side is small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def name():
    return f"staged_{uuid.uuid4().hex}"


def below_join(text):
    return text[text.index("SortMergeJoin"):]


def test_labels_join_transactions_without_exchange(spark, no_broadcast, tmp_path):
    t = benchmark_tables(spark, SF_SMALL)
    want = risk.fraud_by_channel(t.labels, t.transactions)
    assert "Exchange hashpartitioning" in below_join(plan(want))
    txn = stage_by_id(t.transactions, name(), buckets=5, path=str(tmp_path / "txn"))
    labels = stage_by_id(t.labels, name(), buckets=5, path=str(tmp_path / "labels"))
    got = risk.fraud_by_channel(labels, txn)
    assert "Exchange" not in below_join(plan(got))
    assert repr(got.collect()) == repr(want.collect())
    # one file a bucket at most, whatever the number of tasks before
    assert len(txn.inputFiles()) <= 5
    again = risk.fraud_by_channel(read_by_id(spark, name(), str(tmp_path / "labels"), buckets=5), read_by_id(spark, name(), str(tmp_path / "txn"), buckets=5))
    assert "Exchange" not in below_join(plan(again)) and repr(again.collect()) == repr(want.collect())


def test_all_reports_over_the_analysis(spark, no_broadcast):
    t = Tables.from_benchmark(spark, SF_SMALL)
    fa = FraudAnalysis(t, {"users", "cards", "labels", "mcc"})
    want = {r: repr(fa.report(r).collect()) for r in ("fraud_by_channel", "txn_by_channel", "label_counts")}
    fa.stage_by_id(4)
    assert {r: repr(fa.report(r).collect()) for r in want} == want
    assert "Exchange" not in below_join(plan(fa.report("fraud_by_channel")))


def test_rows_without_id_repeated_ids_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (7, "c"), (7, "d"), (1, "e's `x`")], "id long, `odd name` string")
    path = str(tmp_path / "o'clock")
    stage_by_id(df, name(), buckets=3, path=path)
    got = read_by_id(spark, name(), path, buckets=3)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert got.schema == df.schema
    assert stage_by_id(df.limit(0), name(), buckets=3).count() == 0


def test_wrong_number_of_buckets_and_existing_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    stage_by_id(spark.range(100), name(), buckets=6, path=path)
    with pytest.raises(ValueError):
        read_by_id(spark, name(), path, buckets=5)
    with pytest.raises(Exception):
        stage_by_id(spark.range(3), name(), buckets=6, path=path)
    with pytest.raises(ValueError):
        stage_by_id(spark.range(3), name(), buckets=0)
