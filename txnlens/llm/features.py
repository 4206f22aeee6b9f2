"""Hashed word features and structure statistics of whole texts, and the labelled rows to learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.quality_rules import line_repeats, repeated_words
from txnlens.llm.words import Hasher, Slice, mix

STRUCTURE = ("log_words", "log_chars", "word_length", "upper", "digits", "symbols", "exclaim", "punctuation", "one_char_words",
             "long_words", "words_per_line", "distinct_words", "repeated_words", "repeated_lines", "non_ascii")


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Is the row outside the learning rows? Null keys are not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def learning_rows(labels: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """(doc_id, columns as double): at most ``limit`` labelled documents that are not held out.

    A document's labels are the means of its rows. If there are more than ``limit``,
    those of the smallest hashes of doc_id are taken, the same ones each time.
    """
    rows = (labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).dropna(subset=columns, how="all"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(1, b)


def structure(part: Slice, raw: Hasher) -> np.ndarray:
    """One row of STRUCTURE for each row of a slice; ``raw`` is a hasher that keeps case."""
    data, n = part.data, np.diff(part.first)
    kind = np.zeros(256, dtype=np.uint8)
    kind[65:91], kind[48:58], kind[128:] = 1, 2, 5
    kind[list(b"#*$%&|<>")] = 3
    kind[list(b".,;:?\"'()[]{}/\\-_=+@~^`")] = 4
    kind[ord("!")] = 6
    kinds = kind[data]
    at = {k: part.per_row(kinds == k) for k in range(1, 7)}
    chars = part.per_row((data & 0xC0) != 0x80)
    inside = part.per_row(part.inside)
    size = part.ends - part.starts
    words = raw.of_words(part)
    row = part.word_rows()
    distinct = np.bincount(row[np.unique(words ^ mix(row.astype(np.uint64)), return_index=True)[1]], minlength=len(part))
    lines = part.per_row(data == 10) + 1
    return np.stack([
        np.log1p(n), np.log1p(chars), _share(inside, n), _share(at[1], inside), _share(at[2], inside), _share(at[3], inside),
        _share(at[6], inside), _share(at[4], inside), _share(part.per_row_words(size == 1), n), _share(part.per_row_words(size > 25), n),
        np.log1p(n / lines), _share(distinct, n), _share(repeated_words(part, raw), n), _share(line_repeats(part, raw), lines),
        _share(at[5], inside)], axis=1).astype(np.float64)


def word_counts(part: Slice, folded: Hasher, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, buckets, unit-length log counts) of the hashed words of each row; ``folded`` ignores case."""
    row = part.word_rows()
    bucket = (folded.of_words(part) >> np.uint64(64 - bits)).astype(np.int64)
    keys, counts = np.unique(row << bits | bucket, return_counts=True)
    row, bucket, value = keys >> bits, keys & ((1 << bits) - 1), np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(part)))
    return np.searchsorted(row, np.arange(len(part) + 1)), bucket, value / norm[row]
