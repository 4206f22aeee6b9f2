"""Every report through the file readers equals the same report on the benchmark tables."""

import json
import os

import pytest

from conftest import SF_SMALL
from txnlens.analysis import FraudAnalysis
from txnlens.plans.catalog import QUERIES, REPORTS
from txnlens.plans.verify import compare
from txnlens.sources import adapters


def _csv(df, path):
    (df.write.option("header", True).option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return path


@pytest.fixture(scope="module")
def analysis(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sources"))
    labels = os.path.join(d, "labels.json")
    with open(labels, "w") as f:  # small fixture file
        json.dump({"target": {str(r.id): r.Target for r in adapters.fraud_labels(spark, SF_SMALL).collect()}}, f)
    return FraudAnalysis.from_files(
        spark,
        transactions=_csv(adapters.txn_raw(spark, SF_SMALL), os.path.join(d, "transactions")),
        users=_csv(adapters.users_raw(spark, SF_SMALL), os.path.join(d, "users")),
        cards=_csv(adapters.cards(spark, SF_SMALL), os.path.join(d, "cards")),
        labels=labels,
        mcc=_csv(adapters.mcc_codes(spark, SF_SMALL), os.path.join(d, "mcc")),
    )


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_from_files(spark, analysis, name):
    got = analysis.report(name)
    want = QUERIES[name](spark, SF_SMALL)
    verdict = compare([tuple(r) for r in got.collect()], got.columns,
                      [tuple(r) for r in want.collect()], want.columns)
    assert verdict == "exact", verdict


def test_available_depends_on_inputs(spark, tmp_path):
    path = _csv(adapters.txn_raw(spark, SF_SMALL), str(tmp_path / "t"))
    fa = FraudAnalysis.from_files(spark, transactions=path)
    names = fa.available()
    assert "txn_by_channel" in names and "customer_risk" not in names and "label_counts" not in names
    with pytest.raises(ValueError):
        fa.report("gender_counts")


def test_staged_reports_match(spark, analysis):
    names = ["txn_by_channel", "revenue_growth", "customer_tiers", "amount_high_outliers", "dark_web_cards",
             "fraud_by_channel", "customer_risk"]
    before = {n: [tuple(r) for r in analysis.report(n).collect()] for n in names}
    cols = {n: analysis.report(n).columns for n in names}
    analysis.stage(files_per_value=2)
    plan = analysis.report("txn_by_year")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "RLIKE" not in plan  # reads the staged copy, no re-parsing
    for n in names:
        got = analysis.report(n)
        assert compare([tuple(r) for r in got.collect()], got.columns, before[n], cols[n]) == "exact", n
