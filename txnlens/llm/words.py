"""Word and window hashes of whole texts, vectorised over Arrow string columns.

A word is a run of characters outside space and ``\\t\\n\\v\\f\\r``. Texts are read
as the UTF-8 bytes of the Arrow buffer, in slices of a quarter of a megabyte, so the
memory of a task does not depend on how many rows a batch holds. A hash of a byte
range is a difference of two prefix sums of ``table[byte] * base**position``
(modulo 2**64), put back to position 0 with the inverse of the base; windows of
words use the same scheme one level up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD1342543DE82EF95


def is_separator() -> np.ndarray:
    """Lookup by byte: does it end a word?"""
    out = np.zeros(256, dtype=bool)
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole value (splitmix64's last step)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """``base**i`` and its inverse for i below a size that grows on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


class Slice:
    """Some rows of a text column: bytes, row offsets, word bounds and words per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.inside = np.zeros(0, dtype=bool)
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        else:
            gap = separator[data]
            edge = np.zeros(n + 1, dtype=bool)
            edge[offsets] = True
            before, after = edge[:n].copy(), edge[1:].copy()
            before[1:] |= gap[:-1]
            before[0] = True
            after[:-1] |= gap[1:]
            after[-1] = True
            self.inside = ~gap
            self.starts = np.flatnonzero(self.inside & before)
            self.ends = np.flatnonzero(self.inside & after) + 1
        #: words of row i: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def per_row_words(self, flags: np.ndarray) -> np.ndarray:
        """How many words of each row are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


class Hasher:
    """Hashes of words and of word windows. Made inside a task, one per task."""

    def __init__(self, fold: bool = False, seed: int = 1, window_base: int = _WINDOW_BASE) -> None:
        """``fold`` reads A-Z as a-z; different (odd) window bases give independent window hashes."""
        self.table = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, 256, dtype=np.uint64)
        if fold:
            self.table[65:91] = self.table[97:123]
        self.separator = is_separator()
        self.bytes, self.words = Powers(_BASE), Powers(window_base)

    def slices(self, text: pa.Array) -> Iterator[tuple[int, Slice]]:
        """(first row, Slice) for runs of rows of at most SLICE_BYTES, or one longer row. Null reads as empty."""
        text = pc.fill_null(text.cast(pa.large_string()), "")
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            yield at, Slice(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], self.separator)
            at = to

    def ranges(self, part: Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range [start, end)."""
        up, down = self.bytes.upto(len(part.data) + 1)
        sums = np.zeros(len(part.data) + 1, dtype=np.uint64)
        np.cumsum(self.table[part.data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def of_words(self, part: Slice) -> np.ndarray:
        return self.ranges(part, part.starts, part.ends)

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of k consecutive words; one fewer than k runs at the end are left out."""
        return self.spans(words, np.arange(max(0, len(words) - k + 1)), k)

    def spans(self, words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each start."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = self.words.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[:-1], out=sums[1:])
        return mix((sums[starts + k] - sums[starts]) * down[starts] + np.uint64(k))

    def shingles(self, words: np.ndarray, k: int) -> np.ndarray:
        """Sorted distinct hashes of the k-word shingles of one text; a shorter text is one shingle."""
        if not len(words):
            return np.zeros(0, dtype=np.uint64)
        return np.unique(self.windows(words, min(k, len(words))))
