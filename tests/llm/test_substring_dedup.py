import hashlib

import pytest
from brute import removed, words
from llm_inputs import corpus, no_docs  # noqa: F401

from txnlens.llm.substring_dedup import substring_report, without_repeats


@pytest.mark.parametrize("window, start", [(50, 25), (20, 5), (8, 4)])
def test_equals_looking_up_every_window(corpus, window, start):
    rows, docs = corpus
    got = sorted((tuple(r) for r in substring_report(docs, window_words=window, start_words=start).collect()), key=repr)
    want = sorted(((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
                   for d, w, gone in removed(rows, window)), key=repr)
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_texts_keep_what_is_not_removed(corpus):
    rows, docs = corpus
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = {}
    for d, w, gone in removed(rows, 50):
        left.setdefault(d, []).append([x for x, g in zip(w, gone, strict=True) if not g])
    before = {}
    for d, t in rows:
        before.setdefault(d, []).append(t)
    for r in out.collect():
        assert words(r["text"]) in left[r["doc_id"]]
        if r["text"] not in before[r["doc_id"]]:
            assert r["n_chars"] == len(r["text"])


def test_white_space_of_kept_words_stays(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, f"a\n\nb  {passage}\n c\td")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()} == {1: passage, 2: "a\n\nb  c\td"}


def test_a_window_repeated_in_one_document_only_stays(spark):
    text = " ".join(f"p{i % 55}" for i in range(165))
    got = substring_report(spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_empty_table_and_wrong_lengths(no_docs):
    assert substring_report(no_docs).count() == 0
    assert without_repeats(no_docs).columns == no_docs.columns
    with pytest.raises(ValueError):
        substring_report(no_docs, window_words=50, start_words=20)
