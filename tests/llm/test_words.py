"""Hashes of words and windows against Python's own splitting."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import words

from txnlens.llm import words as W


def texts(seed):
    r = random.Random(seed)
    letters = "ab cde\n\t\x0b\x0c\réß中🙂\xa0\x1c  "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(200)] + ["", " ", "x"]


@pytest.mark.parametrize("size", [16, 100, 1 << 18])
def test_words_of_every_slice(monkeypatch, size):
    monkeypatch.setattr(W, "SLICE_BYTES", size)
    hasher, got, seen = W.Hasher(), {}, []
    rows = texts(1)
    for at, part in hasher.slices(pa.array([None, *rows])[1:]):
        hashes = hasher.of_words(part)
        for i in range(len(part)):
            row = words(rows[at + i])
            found = hashes[part.first[i]:part.first[i + 1]]
            assert len(found) == len(row)
            seen.append(at + i)
            for w, h in zip(row, found, strict=True):
                assert got.setdefault(w, h) == h
    assert seen == list(range(len(rows)))
    assert len(set(got.values())) == len(got)


def test_windows_depend_on_their_words_only():
    hasher = W.Hasher()
    r = np.random.default_rng(0)
    row = r.integers(0, 5, 400).astype(np.uint64)
    for k in (1, 3, 7):
        found = {}
        for i, h in enumerate(hasher.windows(row, k)):
            assert found.setdefault(tuple(row[i:i + k]), h) == h
        assert len(set(found.values())) == len(found)
    assert len(hasher.windows(row[:2], 3)) == 0


def test_folding_reads_capitals_as_small_letters():
    hasher = W.Hasher(fold=True)
    (_, part), = hasher.slices(pa.array(["Abc aBC ÄB äb"]))
    a, b, c, d = hasher.of_words(part)
    assert a == b and c != d
