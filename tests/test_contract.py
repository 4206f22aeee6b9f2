"""The driver contract: bench.py prints one JSON line with the required fields."""

import json
import os
import subprocess
import sys

import pytest

from txnlens.plans.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="4", BENCH_KEYS=",".join(QUERIES))
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=1800, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= d.keys()
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["failed"] == {}
    assert set(d["queries"]) == set(QUERIES) and abs(sum(d["queries"].values()) - d["value"]) < 0.01


@pytest.mark.parametrize("missing", ["zstandard", "txnlens.llm", "public_tokenizers"])
def test_entry_without_what_the_operators_need(missing):
    """The reports are there without the operators' package or libraries."""
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
assert not [k for k in e.queries() if k.startswith("op") or k == "pipeline"], e.queries().keys()
assert "txn_by_channel" in e.queries() and set(e.oracle_sql()) == set(e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
