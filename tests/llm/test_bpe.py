import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from llm_inputs import corpus, no_docs  # noqa: F401

from txnlens.llm.bpe import ByteBPE, decode_ids, encode_texts, encoding_report, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        raw = f.read()
    return ByteBPE(raw, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(raw), special_tokens={})


def test_random_texts(both):
    bpe, other = both
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz AEIOU  \n\t 0123 ,.!? 'éüñß中文日本語한국어🙂👍🏽‍\x85\xa0\x1c"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(800)]
    texts += ["", "a" * 5000, "ab" * 2000, " " * 3000, "é" * 1500, "<|endoftext|>", "".join(r.choice("abcde") for _ in range(6000))]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids.tolist() == other.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_queue_and_rows_agree(both):
    bpe, other = both
    r = random.Random(5)
    for n in (1, 2, 17, 700):
        piece = "".join(r.choice("abcdefgh") for _ in range(n))
        want = other.encode_single_token(piece) if n == 1 else None
        rows = bpe.merge_rows([piece.encode(), b"the"])[0].tolist()
        assert rows == bpe.merge_long(piece.encode()).tolist() == other.encode_ordinary(piece)
        assert want is None or rows == [want]


def test_forgetting_known_pieces_changes_nothing(both, monkeypatch):
    bpe, other = both
    monkeypatch.setattr("txnlens.llm.bpe.REMEMBERED", 10)
    for text in ("one two three four five six seven", "eight nine ten eleven twelve", "one two"):
        assert bpe.encode([text])[0].tolist() == other.encode_ordinary(text)


def test_report_and_round_trip(corpus, both):
    rows, docs = corpus
    want = []
    for d, t in rows:
        ids = both[1].encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in encoding_report(docs, PATH, PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = decode_ids(encode_texts(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)


def test_empty_table(no_docs):
    assert encoding_report(no_docs, PATH, PATTERN).count() == 0
