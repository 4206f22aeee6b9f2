import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_inputs import SF_CHECK

from txnlens.llm.features import learning_rows
from txnlens.llm.quality_model import FACTORS, FactorisationMachine, Rows, fit_quality, keep_quality, score_quality
from txnlens.llm.tables import table
from txnlens.llm.toxicity import WORD_LISTS, Chain, fit_chain, score_toxicity


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF_CHECK, "documents"), table(spark, SF_CHECK, "labels")


@pytest.fixture(scope="module")
def machine(tables):
    return fit_quality(*tables)


@pytest.fixture(scope="module")
def chain(tables):
    return fit_chain(*tables)


def outcomes(scored, labels, label):
    got = scored.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").filter("held_out").select("score", "y").collect()
    return np.array([r["score"] for r in got]), np.array([r["y"] for r in got])


def test_pairs_by_the_identity_equal_the_double_sum():
    r = np.random.default_rng(0)
    model = FactorisationMachine(0.3, r.normal(size=20), r.normal(size=(20, FACTORS)), np.zeros(1), np.ones(1))
    index, value = [np.array([1, 4, 9]), np.array([], dtype=int), np.array([0, 19])], [r.normal(size=3), np.zeros(0), r.normal(size=2)]
    rows = Rows(np.array([0, 3, 3, 5]), np.concatenate(index), np.concatenate(value))
    want = [0.3 + sum(model.weight[i] * x for i, x in zip(a, v, strict=True)) + sum(
        model.factor[a[i]] @ model.factor[a[j]] * v[i] * v[j] for i in range(len(a)) for j in range(i)) for a, v in zip(index, value, strict=True)]
    assert model.margin(rows) == pytest.approx(want)


def test_quality_on_held_out_rows(tables, machine):
    docs, labels = tables
    score, y = outcomes(score_quality(docs, machine), labels, "quality")
    assert len(y) > 50 and ((score >= 0.3) == (y == 1)).mean() >= 0.97
    assert score[y == 1].mean() > 0.9 > 0.3 > score[y == 0].mean()


def test_quality_ignores_everything_but_the_text(spark, tables, machine):
    rows = [(1, None, "x"), (None, "", "y"), (1, "some words here", None), (2, "some words here", "de"), (3, "long " * 30000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = score_quality(docs, machine).collect()
    assert [r["doc_id"] for r in got] == [1, None, 1, 2, 3]
    assert got[0]["score"] == got[1]["score"] and got[2]["score"] == got[3]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert got[1]["held_out"] is False
    assert score_quality(docs.limit(0), machine).count() == 0
    kept = keep_quality(docs, machine)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)


def test_learning_rows_are_bounded_and_not_held_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = learning_rows(labels, ["quality"], 100).collect()
    assert len(got) == 100 and got == learning_rows(labels, ["quality"], 100).collect()
    all_of_them = {r["doc_id"]: r["quality"] for r in learning_rows(labels, ["quality"], 10**6).collect()}
    assert set(all_of_them) == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5}


def test_without_labels(spark, tables):
    docs, labels = tables
    assert [r["score"] for r in score_quality(docs.limit(3), fit_quality(docs, labels.limit(0))).collect()] == [0.5] * 3
    got = score_toxicity(docs.limit(3), fit_chain(docs, labels.limit(0))).collect()
    assert [r["toxic"] for r in got] == [0, 0, 0]


def test_toxicity_on_held_out_rows(tables, chain):
    docs, labels = tables
    scored = score_toxicity(docs, chain)
    score, y = outcomes(scored, labels, "toxic")
    assert ((score >= 0.4) & (y == 0)).sum() <= 1 and ((score >= 0.4) & (y == 1)).sum() >= 0.6 * (y == 1).sum()
    assert scored.columns == ["doc_id", "held_out", *[f"p_{c}" for c in WORD_LISTS], "p_toxic", "score", "toxic"]
    assert scored.count() == docs.count()


def test_chain_feeds_earlier_categories_forward():
    r = np.random.default_rng(3)
    first = r.random(600) < 0.4
    noise = r.integers(1, 50, 600)
    rows = [np.array(sorted({0, n} if f else {n})) for f, n in zip(first, noise, strict=True)]
    chain = Chain(np.arange(50))
    start = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    second = first.astype(float)
    unknown = np.where(r.random(600) < 0.3, np.nan, first.astype(float))
    chain.fit(start, np.concatenate(rows), {"a": unknown, "none": np.zeros(600), "b": second}, np.arange(600) % 3)
    assert chain.categories == ["a", "b"] and len(chain.models[1].dense) == 1 and chain.models[1].dense[0] > 0
    p = chain.probabilities(start, np.concatenate(rows))
    assert ((p[:, 1] > 0.5) == first).mean() > 0.99


def test_toxicity_of_odd_rows(spark, chain):
    rows = [(1, None, 1), (None, "", 2), (2, "stupid idiot scum, you worthless moron", None), (2, "stupid idiot scum, you worthless moron", 1)]
    got = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), chain).collect()
    assert [r["toxic"] for r in got] == [0, 0, 1, 1] and got[0]["score"] == got[1]["score"]


def one_by_one_and_reversed(texts, score):
    """Scores of texts all together, each alone, and in reverse order."""
    together = score(texts)
    alone = [score([t])[0] for t in texts]
    return np.array(together), np.array(alone), np.array(score(texts[::-1]))[::-1]


def odd_and_real_texts(tables):
    texts = [r["text"] for r in tables[0].orderBy("doc_id").limit(300).select("text").collect()]
    return [*texts, "", None, "a", texts[0], "long " * 30_000, "!!! $$$"]


def test_quality_does_not_depend_on_the_rows_beside(tables, machine):
    import pyarrow as pa

    from txnlens.llm.words import Hasher

    def score(texts):
        raw, folded = Hasher(), Hasher(fold=True)
        return np.concatenate([machine.score(machine.inputs(part, raw, folded)) for _, part in raw.slices(pa.array(texts, pa.large_string()))])

    together, alone, backwards = one_by_one_and_reversed(odd_and_real_texts(tables), score)
    assert (together == alone).all() and (together == backwards).all()


def test_toxicity_does_not_depend_on_the_rows_beside(tables, chain):
    import pyarrow as pa

    from txnlens.llm.toxicity import feature_ids
    from txnlens.llm.words import Hasher

    def score(texts):
        folded = Hasher(fold=True)
        return np.concatenate([chain.probabilities(*chain.rows(*feature_ids(part, folded), len(part)))
                               for _, part in folded.slices(pa.array(texts, pa.large_string()))])

    together, alone, backwards = one_by_one_and_reversed(odd_and_real_texts(tables), score)
    assert (together == alone).all() and (together == backwards).all()
