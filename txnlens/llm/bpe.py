"""Byte-level BPE in numpy: length-bucketed padded matrices of distinct pieces.

A text is split by the vocabulary's pattern. Each distinct piece is encoded once
(a task remembers a bounded number of them): pieces of similar length form the rows
of one matrix of token ids, and in each round every row merges its leftmost pair of
least rank. Ranks of pairs come from an open-addressing hash table; finished rows
leave the matrix, and the others lose one column.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.tables import text_rows

_NONE = np.int32(2**31 - 1)
#: A piece longer than this many bytes is merged with a queue instead of as a row,
#: whose work grows with the square of its length.
ROW_BYTES = 2048
#: Distinct pieces that a task remembers, and cells of one matrix.
REMEMBERED = 300_000
CELLS = 1 << 21
SLICE_CHARS = 1 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes -> id, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class PairTable:
    """Id of the token that a pair of token ids merges to, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, ids = [], []
        for token, i in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(i)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.ids = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        left, ids = np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int32)
        slot = self._slot(left)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)  # one key for each free slot
            put = free[one]
            self.keys[slot[put]], self.ids[slot[put]] = left[put], ids[put]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, ids, slot = left[rest], ids[rest], (slot[rest] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(24)) & self.mask).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, or _NONE where a pair does not merge (or an id is padding, below 0)."""
        out = np.full(a.shape, _NONE, dtype=np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[open_].astype(np.int64) << 32 | b[open_]
        slot = self._slot(keys)
        while len(open_):
            there = self.keys[slot]
            hit = there == keys
            out[open_[hit]] = self.ids[slot[hit]]
            on = ~hit & (there != -1)
            open_, keys, slot = open_[on], keys[on], (slot[on] + 1) & int(self.mask)
        return out


class ByteBPE:
    """Encoder and decoder of one vocabulary, made inside a task."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        ranks = read_ranks(raw)
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length, as one padded matrix."""
        n, width = len(pieces), max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        out: list = [None] * n
        row = np.arange(n)
        ranks = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), _NONE)
            done = best == _NONE
            for i in np.flatnonzero(done):
                out[row[i]] = ids[i][ids[i] >= 0]
            if done.any():
                ids, ranks, row, at, best = ids[~done], ranks[~done], row[~done], at[~done], best[~done]
                if not len(row):
                    break
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, width), dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), dtype=bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            # only the pairs on either side of the merged token have changed
            has = at > 0
            ranks[line[has], at[has] - 1] = self.pairs.find(ids[line[has], at[has] - 1], ids[line[has], at[has]])
            has = at < width - 2
            ranks[line[has], at[has]] = self.pairs.find(ids[line[has], at[has]], ids[line[has], at[has] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: the same merges, taken from a queue by (rank, place)."""
        import heapq

        bytes_ = self.byte_id[np.frombuffer(piece, dtype=np.uint8)]
        ids = bytes_.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.find(bytes_[:-1], bytes_[1:]).tolist()
        queue = [(r, i) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(queue)
        rank = [*first, int(_NONE)]
        parts = [self.token[i] for i in ids]
        while queue:
            r, i = heapq.heappop(queue)
            if rank[i] != r or ids[i] < 0:
                continue
            j = after[i]
            ids[i], parts[i], ids[j] = r, parts[i] + parts[j], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                if x >= 0:
                    y = after[x]
                    rank[x] = self.ranks.get(parts[x] + parts[y], int(_NONE)) if y < n else int(_NONE)
                    if rank[x] != _NONE:
                        heapq.heappush(queue, (rank[x], x))
            rank[j] = int(_NONE)
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        raw = [p.encode() for p in pieces]
        found: list = [None] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            size = len(raw[order[at]])
            if size > ROW_BYTES:
                found[order[at]] = self.merge_long(raw[order[at]])
                at += 1
                continue
            widest = 1 << max(2, (size - 1).bit_length())  # lengths up to the next power of two share a matrix
            to = at
            while to < len(order) and len(raw[order[to]]) <= widest and (to - at) * widest < CELLS:
                to += 1
            for i, ids in zip(order[at:to], self.merge_rows([raw[i] for i in order[at:to]]), strict=True):
                found[i] = ids
            at = to
        base = len(self.known)
        start = int(self.ends[base])
        flat = np.concatenate(found)
        ends = start + np.cumsum([len(f) for f in found])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.ends) < base + len(found) + 1:
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[start:ends[-1]] = flat
        self.ends[base + 1:base + 1 + len(found)] = ends
        self.known.update(zip(pieces, range(base, base + len(found)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, without special tokens."""
        pieces = [self.split(t) for t in texts]
        new = set().union(*pieces)
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
        new -= self.known.keys()
        if new:
            self.learn(sorted(new))
        out = []
        for p in pieces:
            where = np.fromiter(map(self.known.__getitem__, p), dtype=np.int64, count=len(p))
            start, size = self.ends[where], self.ends[where + 1] - self.ends[where]
            stop = np.cumsum(size)
            total = int(stop[-1]) if len(p) else 0
            out.append(self.flat[np.arange(total) + np.repeat(start - (stop - size), size)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def text_slices(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about ``chars`` characters; null reads as empty."""
    at, size, got = 0, 0, []
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if got and size + len(text) > chars:
            yield at, got
            at, size, got = i, 0, []
        got.append(text)
        size += len(text)
    if got:
        yield at, got


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text), as the vocabulary at ``path`` encodes it.

    The vocabulary file is read once, by the driver, and travels with the tasks. A
    null text is empty and has no ids; a null doc_id is passed on; repeated rows give
    equal ids; other columns are not read.
    """
    with open(path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(raw, pattern)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(bpe.encode(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids array<int>); null ids give an empty text."""
    with open(path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(raw, pattern)
        for batch in batches:
            texts = [bpe.decode(np.asarray(ids.values)).decode("utf-8", "replace") if ids.is_valid else "" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")


def encoding_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: ids written in decimal with commas, and their text.

    Encodes, decodes and digests slice by slice, so no ids are kept. Null text is
    empty: no tokens, both digests of nothing. A null doc_id is passed on, repeated
    rows give equal rows, an empty table an empty one; other columns are not read.
    """
    with open(path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(raw, pattern)
        decimal = [str(i) for i in range(len(bpe.token))]
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
