import base64
import random
from collections import Counter

import pytest
import zstandard
from brute import words
from llm_inputs import corpus, no_docs  # noqa: F401

from txnlens.llm.quality_rules import band, compression_rules, judge

SQUEEZE = zstandard.ZstdCompressor(level=3)


def counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_plain_ones(spark, corpus):
    rows, docs = corpus
    odd = [(1000, "a b c a b c\n\nx\n x\nx\n"), (1001, "| # * é&é <>\n" * 40), (1002, "\n\n"), (1003, "same line here\n" * 30)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted((tuple(r)[:7] for r in compression_rules(more).collect()), key=repr)
    assert got == sorted(((d, *counts(t)) for d, t in [*rows, *odd]), key=repr)
    for r in compression_rules(docs).collect():
        assert r["kept"] == (not r["base_failed"] and r["verdict"] == "ok")


def test_verdicts():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(r.choice(vocabulary) for _ in range(3000)).encode()
    noise = base64.b85encode(bytes(r.randrange(256) for _ in range(14000)))
    assert judge(prose, SQUEEZE)[3] == "ok"
    assert judge(b"the same words again and again " * 300, SQUEEZE)[3] == "repetitive"
    assert judge(noise, SQUEEZE)[3] == "incompressible"
    assert judge(prose + noise, SQUEEZE)[3] == "bad_chunks"
    assert judge(b"", SQUEEZE)[3] == "empty" and judge(b"hi", SQUEEZE)[3] == "ok"


@pytest.mark.parametrize("size", [0, 255, 256, 1023, 5000, 10**9])
def test_bands_widen(size):
    low, high = band(size)
    assert low < high


def test_empty_table(no_docs):
    assert compression_rules(no_docs).count() == 0


def test_short_texts_and_the_rest_of_a_text_are_judged():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(r.choice(vocabulary) for _ in range(6000)).encode()
    noise = base64.b85encode(bytes(r.randrange(256) for _ in range(14000)))
    same = b"the same words again and again " * 300
    for bad in (noise, same):
        for text in (prose[:4000] + bad[:3900], bad[:3900] + prose[:4000], prose[:4096] + bad[:4090], prose[:5000] + bad[:3900], prose[:1500] + bad[:1500]):
            assert judge(text, SQUEEZE)[3] != "ok", len(text)
        assert judge(prose[:8192] + bad[:4095], SQUEEZE)[1:3] == (3, 1)
    for size in (100, 511, 512, 1000, 4096, 8191, 8192, 8193, 12_287, 12_289, 20_000):
        assert judge(prose[:size], SQUEEZE)[2:] == (0, "ok"), size
