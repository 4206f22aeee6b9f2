"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

Text that repeats itself compresses far better than prose of its length, and
random characters (keys, encoded binaries) far worse. Prose compresses better the
longer it is, so the limits depend on the length; a document is judged as a whole
and chunk by chunk, so a repetitive or random stretch inside a long text counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from txnlens.llm.tables import text_rows
from txnlens.llm.words import Hasher, Slice, mix

#: Limits by size: from so many bytes on, the least and the greatest accepted ratio
#: (bytes / compressed bytes). Below the first size a ratio says nothing.
BANDS = (
    (256, 1.00, 3.2),
    (512, 1.20, 3.6),
    (1024, 1.30, 4.2),
    (2048, 1.35, 4.8),
    (4096, 1.40, 5.4),
    (16384, 1.40, 6.5),
    (65536, 1.40, 7.5),
)
CHUNK_BYTES = 4096
#: A document goes if chunks with more than this share of their bytes are outside their bands.
BAD_CHUNK_SHARE = 0.34
LEVEL = 3

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, verdict string")


def band(size: int, bands: tuple = BANDS) -> tuple[float, float]:
    """Least and greatest accepted ratio for a text of ``size`` bytes."""
    at = bisect_right([b[0] for b in bands], size) - 1
    return (0.0, float("inf")) if at < 0 else bands[at][1:]


def judge(raw: bytes, squeeze: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK_BYTES,
          bad_share: float = BAD_CHUNK_SHARE) -> tuple[float, int, int, str]:
    """(ratio, chunks, chunks outside their band, verdict) of one text.

    What is left after the whole chunks is a chunk of its own size, if there is a band
    for it. A text of less than two chunks is judged in halves.
    """
    if not raw:
        return 0.0, 0, 0, "empty"
    ratio = len(raw) / len(squeeze.compress(raw))
    low, high = band(len(raw), bands)
    if len(raw) < 2 * chunk:
        chunk = (len(raw) + 1) // 2
    n = bad = judged = bad_bytes = 0
    for at in range(0, len(raw), chunk):
        part = raw[at:at + chunk]
        if len(part) < bands[0][0]:
            continue
        part_low, part_high = band(len(part), bands)
        outside = not part_low <= len(part) / len(squeeze.compress(part)) <= part_high
        n, bad, judged, bad_bytes = n + 1, bad + outside, judged + len(part), bad_bytes + outside * len(part)
    if ratio > high:
        return ratio, n, bad, "repetitive"
    if ratio < low:
        return ratio, n, bad, "incompressible"
    return ratio, n, bad, "bad_chunks" if bad_bytes > bad_share * judged else "ok"


def line_repeats(part: Slice, hasher: Hasher) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    n, rows = len(part.data), len(part)
    if not n:
        return np.zeros(rows, dtype=np.int64)
    ends = np.concatenate((np.flatnonzero(part.data == 10), part.offsets[1:]))
    starts = np.concatenate((np.flatnonzero(part.data == 10) + 1, part.offsets[:-1]))
    # a line runs from a row's start or a break to the next break or the row's end
    ends, starts = np.sort(ends), np.sort(starts)
    used = np.searchsorted(part.starts, ends) > np.searchsorted(part.starts, starts)
    starts, ends = starts[used], ends[used]
    row = np.searchsorted(part.offsets, starts, side="right") - 1
    keys = hasher.ranges(part, starts, ends) ^ mix(row.astype(np.uint64))
    kept = np.unique(keys, return_index=True)[1]
    return np.bincount(row, minlength=rows) - np.bincount(row[kept], minlength=rows)


def repeated_words(part: Slice, hasher: Hasher, k: int = 3) -> np.ndarray:
    """Per row: words inside a k-word window that the row has twice or more."""
    words = hasher.of_words(part)
    keys = hasher.windows(words, k)
    if not len(keys):
        return np.zeros(len(part), dtype=np.int64)
    row = part.word_rows()
    whole = np.flatnonzero(row[: len(keys)] == row[k - 1:])
    keys = keys[whole] ^ mix(row[whole].astype(np.uint64))
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = whole[counts[inverse] > 1]
    covered = np.zeros(len(words), dtype=bool)
    for j in range(k):
        covered[at + j] = True
    return part.per_row_words(covered)


def compression_rules(docs: DataFrame, *, min_words: int = 50, bands: tuple = BANDS, chunk_bytes: int = CHUNK_BYTES,
                      bad_chunk_share: float = BAD_CHUNK_SHARE) -> DataFrame:
    """Counts, compression ratios and verdict of every text of ``docs`` (doc_id, text).

    One output row for each input row; other columns are not read. A null text
    reads as empty (no words, so base_failed), a null doc_id is passed on, repeated
    rows give equal results, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, squeeze = Hasher(), zstandard.ZstdCompressor(level=LEVEL)
        symbol = np.zeros(256, dtype=bool)
        symbol[list(b"#*$%&|<>")] = True
        for batch in batches:
            for at, part in hasher.slices(batch.column(1)):
                n = np.diff(part.first)
                chars = part.per_row(part.inside & ((part.data & 0xC0) != 0x80))
                repeats = repeated_words(part, hasher)
                failed = (n < min_words) | (100 * repeats > 50 * n)
                raw = part.data.tobytes()
                told = [judge(raw[a:b], squeeze, bands, chunk_bytes, bad_chunk_share)
                        for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
                kept = ~failed & np.array([t[3] == "ok" for t in told], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(n), pa.array(chars),
                     pa.array(part.per_row(symbol[part.data])), pa.array(line_repeats(part, hasher)), pa.array(repeats),
                     pa.array(failed), pa.array(kept), pa.array([t[0] for t in told], pa.float64()),
                     pa.array([t[1] for t in told], pa.int64()), pa.array([t[2] for t in told], pa.int64()),
                     pa.array([t[3] for t in told], pa.string())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    return text_rows(docs).mapInArrow(run, SCHEMA)
