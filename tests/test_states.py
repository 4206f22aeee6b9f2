"""Merged states of batches against the reports over all transactions."""

import random
from datetime import datetime, timedelta

import pytest

from txnlens.operators import risk
from txnlens.operators.states import append_states, read_states, states

SCHEMA = "id long, date timestamp_ntz, year int, client_id long, card_id long, merchant_id long, merchant_state string, amount double"


@pytest.fixture(scope="module")
def txn(spark):
    r = random.Random(4)
    rows = []
    for i in range(700):
        date = datetime(2015, 1, 1) + timedelta(hours=r.randrange(40000)) if i % 50 else None
        rows.append((i, date, date and date.year, r.choice([None, 0, -5, -40000, 32768, 32769, r.randrange(100), r.randrange(10**12)]), r.randrange(9000),
                     r.choice([None, r.randrange(70000)]), r.choice(["CA", "NY", "ONLINE", None]), r.choice([None, r.randrange(-9999, 10**6) / 100, 0.1, 1e9 + 0.01])))
    return spark.createDataFrame(rows, SCHEMA)


REPORTS = [("overview", risk.overview), ("revenue_growth", risk.revenue_growth), ("geography", risk.geography)]


@pytest.mark.parametrize("name,report", REPORTS)
def test_old_states_and_new_rows_equal_everything(txn, tmp_path, name, report):
    path = str(tmp_path / "states")
    append_states(txn.filter("id < 300"), path, "first")
    append_states(txn.filter("id >= 600"), path, "third/one")
    append_states(txn.filter("id < 10"), path, "second")  # a run that is repeated
    got = append_states(txn.filter("id >= 300 and id < 600"), path, "second")
    want = report(txn).collect()
    assert getattr(got, name)().collect() == want
    assert getattr(got.compact(), name)().collect() == want
    assert getattr(read_states(txn.sparkSession, path), name)().collect() == want


def test_states_are_small_and_only_new_rows_are_read(txn, tmp_path):
    path = str(tmp_path / "states")
    append_states(txn.filter("id < 300"), path, "a")
    merged = read_states(txn.sparkSession, path).union(states(txn.filter("id >= 300")))
    assert merged.revenue_growth().collect() == risk.revenue_growth(txn).collect()
    assert merged.compact().ids.groupBy("kind", "part", "bucket").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("name,report", REPORTS)
def test_no_rows(txn, name, report):
    none = txn.limit(0)
    assert getattr(states(none), name)().collect() == report(none).collect()
    assert getattr(states(none).union(states(txn)), name)().collect() == report(txn).collect()
