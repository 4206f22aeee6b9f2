"""CSV records over several lines, in files cut at any place."""

import os

import pandas as pd
import pytest

from txnlens.schemas import MCC
from txnlens.sources.files import parse_failures, read_mcc

TEXT = ('code,description\n1,plain\n2,"two\nlines"\n3,"a ""quoted""\n\n""word"", and\nfour lines"\n'
        '4,"closed"\n"5","\n"\n6,"x"\n7,"last, with\nbreak"')


def pairs(df):
    return sorted((r["code"], r["description"]) for r in df.collect())


@pytest.fixture()
def cut(spark):
    """Sets the size of the splits."""
    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0b")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield to
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def write(folder, texts):
    os.makedirs(folder)
    for i, t in enumerate(texts):
        with open(f"{folder}/{i}.csv", "w", newline="") as f:
            f.write(t)
    return folder


@pytest.mark.parametrize("size", [1, 7, 13, 22, 29, 41, 58, 1000])
def test_equals_pandas_wherever_files_are_cut(spark, tmp_path, cut, size):
    path = write(str(tmp_path / "csv"), [TEXT, TEXT + "\n8,more\n", "code,description\n9,\"one\nmore\"\n"])
    want = pd.concat([pd.read_csv(f"{path}/{i}.csv") for i in range(3)])
    cut(size)
    df = read_mcc(spark, path, quoted_breaks=True)
    assert pairs(df) == sorted(zip(want["code"].tolist(), want["description"].tolist(), strict=True))


def test_every_place_of_one_file(spark, tmp_path, cut):
    text = 'code,description\n1,"a\nb"\n2,c\n'
    path = write(str(tmp_path / "csv"), [text])
    for size in range(1, len(text) + 1, 3):
        cut(size)
        assert pairs(read_mcc(spark, path, quoted_breaks=True)) == [(1, "a\nb"), (2, "c")]


def test_carriage_returns_bad_lines_and_headers(spark, tmp_path):
    path = write(str(tmp_path / "a"), ['code,description\r\n1,"a\r\nb"\r\n2,c,d\r\nx,e\r\n'])
    assert pairs(read_mcc(spark, path, quoted_breaks=True).filter("code = 1")) == [(1, "a\r\nb")]
    assert {r["column"]: r["failures"] for r in parse_failures(spark, path, MCC, quoted_breaks=True).collect()} == {"code": 1, "(line)": 1}
    other = write(str(tmp_path / "b"), ["code,description\n1,a\n", "description,code\nb,2\n"])
    with pytest.raises(Exception, match="another header"):
        read_mcc(spark, other, quoted_breaks=True).collect()
    with pytest.raises(ValueError):
        read_mcc(spark, other, quoted_breaks=True, by_header=True)
    empty = write(str(tmp_path / "c"), ["code,description\n"])
    assert read_mcc(spark, empty, quoted_breaks=True).collect() == []
