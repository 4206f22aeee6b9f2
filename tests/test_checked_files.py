"""Rejected rows beside good ones, and label objects with commas inside strings, in files cut at any place."""

import json
import os

import pandas as pd
import pytest

from txnlens.schemas import MCC, TXN
from txnlens.sources import good_rows, read_label_map, read_typed_csv, rejected_rows, rejection_counts, write_checked
from txnlens.sources.files import LINE

LINES = ["1,2019-01-02 03:04:05,10,20,$1.50,Chip,30,City,ST,10001,5411,",
         "x,2019-01-02 03:04:05,10,20,$2.50,Chip,30,City,ST,10001,5411,",
         "3,no date,ten,20,$3.50,Chip,30,City,ST,10001,5411,",
         "4,2019-01-02 03:04:05,10,20",
         "5,2019-01-02 03:04:05,10,20,$5.50,Chip,30,City,ST,10001,5411,,extra",
         "6,,10,20,n/a,Chip,30,NA,,,5411,\"Bad PIN, once\"",
         ",2019-01-02 03:04:05,10,20,$7.50,Chip,30,City,ST,10001,5411,"]
HEADER = ",".join(f.name for f in TXN.fields)


@pytest.fixture()
def sizes(spark):
    """Sets the size of the splits."""
    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield to
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def folder(path, texts):
    os.makedirs(path)
    for i, t in enumerate(texts):
        with open(f"{path}/{i}", "w", newline="") as f:
            f.write(t)
    return str(path)


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_good_and_rejected_rows_are_all_rows(spark, tmp_path, sizes, size):
    assert len(TXN.fields) == 12
    path = folder(tmp_path / "in", [HEADER + "\n" + "\n".join(LINES) + "\n", HEADER + "\n" + "\n".join(LINES[:2])])
    sizes(size)
    checked = write_checked(spark, path, str(tmp_path / "out"), TXN, required=["id"])
    good, rejected = good_rows(checked), rejected_rows(checked)
    assert good.count() + rejected.count() == len(LINES) + 2
    all_rows = [r for r in read_typed_csv(spark, path, TXN).collect() if r["id"] in (1, 6)]
    assert good.columns == [f.name for f in TXN.fields] and good.dtypes == [(f.name, f.dataType.simpleString()) for f in TXN.fields]
    assert sorted(map(key, good.collect())) == sorted(map(key, all_rows))
    told = sorted((sorted(r["reasons"]), r["source"]) for r in rejected.collect())
    assert [t for t in told if t[0] == [LINE]] == [([LINE], LINES[3]), ([LINE], LINES[4])]
    fields = [(r, json.loads(s)) for r, s in told if r != [LINE]]
    assert sorted((r, f.get("id"), f.get("date")) for r, f in fields if f.get("id")) == [
        (["client_id", "date"], "3", "no date"), (["id"], "x", "2019-01-02 03:04:05"), (["id"], "x", "2019-01-02 03:04:05")]
    assert {r["reason"]: r["rows"] for r in rejection_counts(checked).collect()} == {"id": 3, "date": 1, "client_id": 1, LINE: 2}


def test_checked_files_are_pruned_and_written_again(spark, tmp_path):
    path = folder(tmp_path / "in", ['code,description\n1,a\nx,b\n2,"c\nd"\n'])
    out = str(tmp_path / "out")
    for _ in range(2):
        write_checked(spark, path, out, MCC, quoted_breaks=True)
    assert sorted(map(tuple, good_rows(spark.read.parquet(out)).collect())) == [(1, "a"), (2, "c\nd")]
    assert [(r["reasons"], json.loads(r["source"])) for r in rejected_rows(spark.read.parquet(out)).collect()] == [(["code"], {"code": "x", "description": "b"})]
    plan = good_rows(spark.read.parquet(out))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Python" not in plan
    with pytest.raises(ValueError):
        write_checked(spark, folder(tmp_path / "b", ["code,reasons\n1,a\n"]), out, MCC)


def test_files_without_bad_or_without_any_rows(spark, tmp_path):
    for name, text, n in (("a", "code,description\n1,a\n", 1), ("b", "code,description\n", 0)):
        out = str(tmp_path / f"out-{name}")
        checked = write_checked(spark, folder(tmp_path / name, [text]), out, MCC)
        assert good_rows(checked).count() == n and rejected_rows(checked).count() == 0 and rejection_counts(checked).collect() == []
        assert good_rows(checked).columns == ["code", "description"]


LABELS = {"1": "No", "2": "Yes, twice", "3": 'a "quoted, word", here', "4": "back\\slash, \\", "5": ",", "6": ",,", "7": '"', "8": "é, ü", "9": "last"}


@pytest.mark.parametrize("layout", [{}, {"indent": 1}, {"separators": (",", ":")}])
def test_labels_with_commas_wherever_the_file_is_cut(spark, tmp_path, sizes, layout):
    text = json.dumps({"target": LABELS}, ensure_ascii=False, **layout)
    path = folder(tmp_path / "json", [text])
    want = pd.read_json(f"{path}/0", dtype=False)["target"]
    for size in (1, 5, 11, 37, 1 << 20):
        sizes(size)
        got = read_label_map(spark, path, quoted_commas=True)
        assert sorted((r["id"], r["Target"]) for r in got.collect()) == sorted((int(i), t) for i, t in want.items())
    sizes(11)
    assert spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() >= len(text) // 11
    with pytest.raises(Exception, match="not an id/label pair"):
        read_label_map(spark, path).collect()


def test_reports_over_such_files(spark, tmp_path):
    from txnlens.analysis import FraudAnalysis

    txn = folder(tmp_path / "txn", [HEADER + "\n" + LINES[0].replace("City", '"Ci\nty, far"') + "\n"])
    labels = folder(tmp_path / "json", [json.dumps({"target": {"1": "Yes, twice", "2": "No"}})])
    fa = FraudAnalysis.from_files(spark, transactions=txn, labels=labels, quoted_breaks=True, quoted_commas=True)
    assert {r["Target"] for r in fa.report("label_counts").collect()} == {"Yes, twice", "No"}
    assert fa.report("txn_by_channel").count() == 1
