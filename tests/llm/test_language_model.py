import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import fold, words
from llm_inputs import SF_CHECK, corpus, no_docs  # noqa: F401

from txnlens.llm import language_model as lm
from txnlens.llm.tables import table


def plain(rows):
    """{row: (held out, tokens, known, N, base)} by counting."""
    out = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    tokens = [[("word", w) for w in words(fold(t))] + [("end",)] for _, t in rows]
    c = Counter(x for held, ts in zip(out, tokens, strict=True) if not held for x in ts)
    n, v = sum(c.values()), len(c)
    return [(held, len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts))
            for held, ts in zip(out, tokens, strict=True)]


def check(rows, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(d, *p[1:4], p[0], p[4]) for (d, _), p in zip(rows, plain(rows), strict=True)], key=key)
    mine = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"], r["base_score"]) for r in got], key=key)
    assert [w[:5] for w in want] == [m[:5] for m in mine]
    assert [m[5] for m in mine] == pytest.approx([w[5] for w in want], abs=1e-6)


def test_counts_and_base_score_of_odd_rows(spark, corpus):
    rows, docs = corpus
    got = lm.score_language(docs).collect()
    check(rows, got)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    texts = {(d, len(words(t)) + 1): " ".join(words(fold(t))) for d, t in rows}
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r["doc_id"], r["n_tokens"]], set()).add(r["score"])
    assert len(by_text) < len(rows) - 20 and {t[:20]: s for t, s in by_text.items() if len(s) > 1} == {}  # copies score alike, wherever they stand


def test_rare_words_are_joined(spark, corpus, monkeypatch):
    rows, docs = corpus
    counted = lm.count_words(docs, held=50)
    assert sorted(counted.collect()) == sorted(lm.count_words(docs).collect())
    real = lm.read_counts
    assert real(counted, words=5, frequent=8).words.size < 14 < real(counted, words=5).words.size
    monkeypatch.setattr(lm, "read_counts", lambda c: real(c, words=5, frequent=8))
    check(rows, lm.score_language(docs).collect())


def test_empty_tables_and_only_held_out_rows(spark, no_docs):
    assert lm.score_language(no_docs).collect() == []
    out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "Some text") for i in out]
    got = lm.score_language(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    assert all(r["train_tokens"] == 0 and r["base_score"] == pytest.approx(0) for r in got)


def test_model_is_normalised_over_symbols():
    r = np.random.default_rng(1)
    model = lm.LogBilinear(*[r.normal(size=s).astype(np.float32) for s in ((9, 4), (9, 4), (2, 4), 9)])
    contexts = np.array([[i, j] for i in range(9) for j in range(9)], dtype=np.int32)
    totals = model.no_totals()
    total = sum(np.exp(model.log_probabilities(contexts, np.full(81, s), totals)) for s in range(9))
    assert total == pytest.approx(np.ones(81), abs=1e-5)
    want = [[sum(model.place[j] * model.before[c[j]] for j in range(2)) @ model.after[s] + model.bias[s] for s in range(9)] for c in contexts]
    log_total = np.log(np.exp(want).sum(axis=1))  # without the grid of 1/256
    assert model.log_probabilities(contexts, np.arange(81) % 9, totals) == pytest.approx([w[i % 9] - log_total[i] for i, w in enumerate(want)], abs=0.06)
    alone = [model.log_totals(contexts[i:i + 1])[0] for i in range(81)]
    assert alone == list(model.log_totals(contexts))


def test_shares_of_a_class_sum_to_one(spark, corpus):
    counted = lm.count_words(corpus[1])
    counts = lm.read_counts(counted, words=10)
    own = set(counts.own.view(np.int64).tolist())
    share = Counter()
    for r in counted.filter("class >= 0").collect():
        if r["word"] not in own:
            share[r["class"]] += (r["n"] + lm.ALPHA) / 10 ** counts.class_log_total()[r["class"]]
    for k, s in share.items():
        assert s + lm.ALPHA / 10 ** counts.class_log_total()[k] == pytest.approx(1)


def test_noise_contrastive_fit_finds_a_chain():
    """A chain over five symbols, each followed by the next one nine times in ten."""
    r = random.Random(0)
    chain = [0]
    for _ in range(60000):
        chain.append((chain[-1] + 1) % 5 if r.random() < 0.9 else r.randrange(5))
    x = np.array(chain)
    context, symbol = np.stack((x[1:-1], x[:-2]), axis=1).astype(np.int32), x[2:]
    unigram = np.full(5, 0.2)
    start = lm.LogBilinear.blank(unigram, width=8)
    trainer = lm.Trainer(start, unigram, noise=16)
    for _ in range(4):
        for at in range(0, len(symbol), 500):
            trainer.step(context[at:at + 500], symbol[at:at + 500])
    best = 0.92 * math.log(0.92) + 0.08 * math.log(0.02)
    assert trainer.model.log_probabilities(context, symbol, trainer.model.no_totals()).mean() > best - 0.1
    assert start.log_probabilities(context, symbol, start.no_totals()).mean() == pytest.approx(math.log(0.2), abs=0.05)


def test_better_than_unigrams_on_held_out_rows(spark):
    got = lm.score_language(table(spark, SF_CHECK, "documents")).filter("held_out").groupBy().sum("base_score", "score", "n_tokens").first()
    assert got["sum(score)"] > got["sum(base_score)"] + 0.1 * got["sum(n_tokens)"]
