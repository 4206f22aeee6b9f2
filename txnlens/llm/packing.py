"""Packing of documents into sequences by the sum-of-squares rule.

Each task packs its own rows online. N[h] counts the open sequences filled to level
h; a piece of n tokens goes where it makes the sum of N[h]**2 smallest: into a
sequence of level h (one fewer there, one more at h + n, none if that is full) or
into a new one. A document gives whole sequences as long as it can and its rest is
one piece. At the end of a task the emptiest of its open sequences are cut up to fill
the gaps of the fullest; the last one is cut into lengths that are powers of two,
which need no padding. Open sequences hold ids of the task's own rows, 4 bytes each,
so they are never larger than the task's part of the table.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from txnlens.llm.bpe import read_ranks, text_slices
from txnlens.llm.tables import text_rows

SEQUENCE = 1024
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: (doc_id, start in the document, tokens of the document, ids)
Piece = tuple


class Levels:
    """Open sequences by fill level."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece shorter than a sequence where the sum of squared counts ends smallest; a filled sequence is returned."""
        n, count, size = len(piece[3]), self.count, self.size
        # change of the sum of squares: 2 N + 1 at the level that gains, 1 - 2 N at the one that loses
        gain = 2 * count[n:] + 1
        gain[-1] = 0  # a full sequence is no longer counted
        change = gain[: size - n + 1] + np.where(count[: size - n + 1] > 0, 1 - 2 * count[: size - n + 1], 1 << 40)
        change[0] = gain[0]  # level 0: a new sequence
        at = size - n - int(change[::-1].argmin())  # the fullest of equal choices
        sequence = []
        if at:
            sequence = self.open[at].pop()
            count[at] -= 1
        sequence.append(piece)
        if at + n == size:
            return sequence
        self.open[at + n].append(sequence)
        count[at + n] += 1
        return None

    def total(self) -> int:
        return int(self.count.sum())

    def consolidate(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Close all: full sequences, and the pieces (of fewer tokens than a sequence) that are left over."""
        order = [s for level in range(self.size, 0, -1) for s in self.open[level]]
        self.count[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        full, first, last = [], 0, len(order)
        spare: list[Piece] = []
        while first < last:
            sequence = order[first]
            first += 1
            room = self.size - sum(len(p[3]) for p in sequence)
            while room and (spare or first < last):
                if not spare:
                    last -= 1
                    spare = order[last]
                doc, start, total, ids = spare.pop()
                if len(ids) > room:
                    spare.append((doc, start + room, total, ids[room:]))
                    ids = ids[:room]
                sequence.append((doc, start, total, ids))
                room -= len(ids)
            if room:
                return full, sequence
            full.append(sequence)
        return full, spare


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Sequences whose lengths are different powers of two, the largest first."""
    left = sum(len(p[3]) for p in pieces)
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            doc, start, total, ids = pieces.pop()
            if len(ids) > room:
                pieces.append((doc, start + room, total, ids[room:]))
                ids = ids[:room]
            sequence.append((doc, start, total, ids))
            room -= len(ids)
        yield sequence


def pack(documents: Iterator[tuple[int | None, np.ndarray]], size: int = SEQUENCE, max_open: int | None = None) -> Iterator[list[Piece]]:
    """Closed sequences, each a list of pieces, for a stream of (doc_id, ids).

    ``max_open`` is for streams without an end: with more open sequences than that,
    all are closed as at the end, and documents are cut for it. By default the rule
    alone decides until the stream ends.
    """
    levels = Levels(size)
    for doc, ids in documents:
        total = len(ids)
        whole = total - total % size
        for at in range(0, whole, size):
            yield [(doc, at, total, ids[at:at + size])]
        if whole < total:
            filled = levels.place((doc, whole, total, ids[whole:].copy()))
            if filled:
                yield filled
        if max_open is not None and levels.total() > max_open:
            full, rest = levels.consolidate()
            yield from full
            if rest:
                level = sum(len(p[3]) for p in rest)
                levels.open[level].append(rest)
                levels.count[level] += 1
    full, rest = levels.consolidate()
    yield from full
    yield from powers_of_two(rest)


def added_tokens(path: str) -> dict[str, int]:
    """Text -> id of the added tokens of the tokenizer file at ``path``, which are read out of a text before it is split."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    tokens = {t["content"]: t["id"] for t in found}
    if any(t.get(flag) for t in found for flag in ("single_word", "lstrip", "rstrip")) or any(a != b and b.startswith(a) for a in tokens for b in tokens):
        raise ValueError(f"{path}: added tokens that match more or less than their text, or begin with another one")
    return tokens


def pack_documents(docs: DataFrame, path: str, pattern: str, *, special: dict[str, int] | None = None, size: int = SEQUENCE,
                   end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text).

    A document is its ids by the vocabulary at ``path``, with those of ``special``
    (text -> id) wherever their text stands, and then ``end_id``. Rows:
    doc_id, start (ids of the document before the piece), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id and offset
    in the sequence. sequence_id holds the partition and a count, so tasks need not
    agree on anything. A null text is one end id; a null doc_id is passed on; repeated
    rows are packed each; an empty table gives an empty result; other columns are
    not read. How rows are packed depends on the partitions of ``docs``.
    """
    with open(path, "rb") as f:
        raw = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(raw), special_tokens=special or {})
        base = TaskContext.get().partitionId() << 33

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                keys = batch.column(0)
                for at, texts in text_slices(batch.column(1)):
                    for i, text in enumerate(texts, at):
                        yield keys[i].as_py(), np.append(encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()), np.uint32(end_id)).astype("<u4")

        def rows(block: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block, strict=True)],
                                              names=[c.split()[0] for c in SCHEMA.split(", ")])

        block: list[tuple] = []
        for number, sequence in enumerate(pack(documents(), size)):
            offset = 0
            for doc, start, total, ids in sequence:
                block.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + number, offset))
                offset += len(ids)
            if len(block) >= 10_000:
                yield rows(block)
                block = []
        if block:
            yield rows(block)

    return text_rows(docs).mapInArrow(run, SCHEMA)
