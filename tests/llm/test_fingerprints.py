import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import shingles
from llm_inputs import corpus, no_docs  # noqa: F401

from txnlens.llm.fingerprints import (_above, _ranges, bottom_k, containment, decode, distinct, document_sketches, encode, fingerprint_edits, merge,
                                      merge_sketches, resemblance, sketches)
from txnlens.llm.words import Hasher


def follower(rows):
    """The next row by descending doc_id; null ids last, equal ids by text."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), rows[i][1] or ""))
    return {order[i]: order[(i + 1) % len(order)] for i in range(len(order))}


def test_edits_and_likeness(corpus):
    rows, docs = corpus
    after = follower(rows)
    want, exact = [], {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[after[i]][1] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        a, b, c = (shingles(x, 5) for x in (t, edited, nxt))
        exact[want[-1]] = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
    got = fingerprint_edits(docs).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        edit, nxt = exact[tuple(r)[:3]]
        assert abs(r["near_edited"] - edit) < 0.2 and abs(r["near_next"] - nxt) < 0.2
    texts = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in got}
    assert texts[3, len(rows[3][1])] == texts[93, len(rows[3][1])]  # a copy


def test_any_number_of_ranges_gives_the_same(spark, corpus):
    _, docs = corpus
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted((tuple(r) for r in fingerprint_edits(docs).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] == out[2]


def test_one_row_and_empty_table(spark, no_docs):
    (r,) = fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint_edits(no_docs).count() == 0


def test_estimates():
    r = np.random.default_rng(1)
    a, b = np.unique(r.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2)), np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    both = np.union1d(a, b)
    k = 1024
    x, y, z = (bottom_k(s, k) for s in (a, b, both))
    assert merge(x, y, k).tolist() == z.tolist()
    assert distinct(z, k) == pytest.approx(len(both), rel=0.1)
    assert resemblance(x, z, k) == pytest.approx(len(a) / len(both), abs=0.06)
    assert containment(x, z, k) == pytest.approx(1, abs=0.08) and containment(y, x, k) < 0.05
    assert decode(encode(x)).tolist() == x.tolist()
    few, none = bottom_k(a[:10], k), bottom_k(a[:0], k)
    assert distinct(few, k) == 10 and resemblance(few, bottom_k(a[5:15], k), k) == pytest.approx(5 / 15)
    assert resemblance(none, none) == 1 and resemblance(none, few) == 0 and containment(none, few) == 0


def test_parts_merge_to_the_whole(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(200)) for _ in range(30)]
    parts = document_sketches(spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: r["sketch"] for r in merge_sketches(parts, "doc_id", salts=4).collect()}
    hasher = Hasher(fold=True)
    for i in range(3):
        whole = bottom_k(np.array([], dtype=np.uint64))
        for s in sketches(pa.array(texts[i::3]), hasher):
            whole = merge(whole, s)
        assert got[i] == whole.tolist()


def test_merging_gathers_no_whole_sketches(spark):
    rows = [("one", [5, -7, i]) for i in range(300)] + [("one", [5, -7])] * 300 + [("none", None), ("empty", []), (None, [3, 1]), (None, None)]
    merged = merge_sketches(spark.createDataFrame(rows, "id string, sketch array<long>").repartition(5), "id", k=128)
    got = {r["id"]: r["sketch"] for r in merged.collect()}
    assert got == {"one": [-7, *range(127)], "none": [], "empty": [], None: [1, 3]}
    # arrays are made of values that a rank has cut to k a group, not of the sketches of a group
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan and plan.index("collect_list") < plan.index("row_number")


@pytest.mark.parametrize("cuts", [[], [5], [-(1 << 63), -3, 0, 7], list(range(0, 300, 3))])
def test_bisection_counts_cuts_above(spark, cuts):
    keys = [-(1 << 63), -4, -3, -1, 0, 1, 6, 7, 8, 299, 300, (1 << 63) - 1]
    rows = spark.createDataFrame([(k,) for k in keys], "at long")
    got = {r["at"]: r["n"] for r in rows.select("at", _above(cuts, rows["at"]).alias("n")).collect()}
    assert got == {k: sum(c > k for c in cuts) for k in keys}


def test_ranges_have_equal_work_and_a_task_each(spark):
    """Long texts at one end, very many short ones at the other."""
    rows = spark.range(8000).selectExpr("id AS at", "repeat('a', CAST(IF(id < 400, 20000, 100) AS INT)) AS text")
    cuts = _ranges(rows, 20)
    assert 15 <= len(cuts) <= 19
    got = rows.groupBy(_above(cuts, rows["at"]).alias("part")).agg({"at": "count", "text": "max"}).collect()
    work = {}
    for r in rows.selectExpr("at", "octet_length(text) AS size").collect():
        part = sum(c > r["at"] for c in cuts)
        a, b = work.get(part, (0, 0))
        work[part] = a + 1, b + r["size"]
    total = 400 * 20000 + 7600 * 100
    shares = [(a / 8000 + b / total) / 2 for a, b in work.values()]
    assert len(got) == len(cuts) + 1 and max(shares) < 2 / 20
    docs = rows.selectExpr("at AS doc_id", "text")
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        tasks = fingerprint_edits(docs).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tasks >= 15


def test_containment_and_distinct_are_those_of_the_sets(corpus):
    rows, docs = corpus
    exact = {(d, len(t or "")): len(shingles(t or "", 5)) for d, t in rows}
    for r in fingerprint_edits(docs).collect():
        n = exact[r["doc_id"], r["n_chars"]]
        assert r["n_distinct"] == n if n < 128 else abs(r["n_distinct"] / n - 1) < 0.4
        assert 0 <= r["containment"] <= 1 and (n > 0 or r["containment"] == 0)
