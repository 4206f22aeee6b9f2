"""Exact substring deduplication by level-wise doubling of word windows.

Windows of a short length are counted first. Only where such a window occurs in
more than one document are windows of twice that length looked at, and so on up to
the wanted length or until none is left.

The first level need not count every short window. A window of 2L words contains
L + 1 windows of L words, and equal long windows agree on which of them has the
smallest hash; so the smallest of each run of L + 1 is counted, about one in L / 2.
Texts with equal word sequences are one class: all its documents but the one with
the smallest doc_id lose every word without being looked at again.

Hashes of the counted windows have 64 bits, which only pick candidates; what is
removed is decided by 96 bits of two independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.tables import cut, only, text_rows
from txnlens.llm.words import Hasher, Slice

WINDOW_WORDS = 50
START_WORDS = 25
_SECOND_BASE = 0xA0761D6478BD642F


def _sliding(x: np.ndarray, k: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of k values."""
    width = 1
    while 2 * width <= k:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (k - width)], x[k - width:]) if k > width else x


def least_grams(part: Slice, words: np.ndarray, hasher: Hasher, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram of ``size`` words, smallest gram of each window of 2 * size words).

    A window that would run over the end of its row has 0.
    """
    if len(words) < 2 * size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    grams = hasher.windows(words, size) | np.uint64(1)
    least = _sliding(grams, size + 1, np.minimum)
    row = part.word_rows()
    return grams, np.where(row[: len(least)] == row[2 * size - 1:], least, np.uint64(0))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


def _digest(words: np.ndarray) -> bytes | None:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None


def _signatures(start: int):
    """Per row: words, digests of the words and of the words joined by a space, smallest grams of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, part in hasher.slices(batch.column(1)):
                words = hasher.of_words(part)
                grams, least = least_grams(part, words, hasher, start)
                bounds = list(zip(part.first[:-1], part.first[1:], strict=True))
                anchors = [np.unique(least[a:max(a, b - 2 * start + 1)]).view(np.int64) for a, b in bounds]
                plain = np.where(part.inside, part.data, np.uint8(32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(np.diff(part.first)),
                     pa.array([_digest(words[a:b]) for a, b in bounds], pa.binary()),
                     pa.array([hashlib.sha256(_joined(part, plain, np.arange(a, b))).hexdigest() for a, b in bounds], pa.string()),
                     _lists(np.concatenate(anchors), [len(x) for x in anchors])],
                    names=["doc_id", "hash", "n_words", "digest", "sha", "anchors"])

    return run


def _joined(part: Slice, plain: np.ndarray, words: np.ndarray) -> bytes:
    """The given words of a slice joined by one space, UTF-8."""
    if not len(words):
        return b""
    starts, size = part.starts[words], part.ends[words] - part.starts[words] + 1
    if words[-1] - words[0] + 1 == len(words) and part.ends[words[-1]] - starts[0] == size.sum() - 1:
        return plain[starts[0]:part.ends[words[-1]]].tobytes()  # single separators already
    ends = np.cumsum(size)
    source = np.arange(ends[-1]) + np.repeat(starts - (ends - size), size)
    out = plain[np.minimum(source, len(plain) - 1)]
    out[ends - 1] = 32
    return out[:-1].tobytes()


def _windows(length: int, pick):
    """Per row: both hashes and the position of each window of ``length`` words that ``pick`` chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(), Hasher(window_base=_SECOND_BASE)
        for batch in batches:
            hints = batch.column(3)
            for at, part in one.slices(batch.column(2)):
                words = one.of_words(part)
                chosen = [pick(part, words, one, i, np.asarray(hints[at + i].values)) for i in range(len(part))]
                starts = np.concatenate(chosen).astype(np.int64) if chosen else np.zeros(0, dtype=np.int64)
                counts = [len(c) for c in chosen]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)),
                     _lists(one.spans(words, starts, length).view(np.int64), counts),
                     _lists((two.spans(words, starts, length) >> np.uint64(32)).astype(np.uint32).view(np.int32), counts),
                     _lists((starts - np.repeat(part.first[:-1], counts)).astype(np.int32), counts)],
                    names=["doc_id", "part", "h1", "h2", "pos"])

    return run


def _by_grams(start: int):
    """Windows of 2 * start words whose smallest gram is one of the row's repeated grams."""

    def pick(part: Slice, words: np.ndarray, hasher: Hasher, i: int, grams: np.ndarray) -> np.ndarray:
        a, b = part.first[i], part.first[i + 1]
        if b - a < 2 * start:
            return np.zeros(0, dtype=np.int64)
        least = _sliding(hasher.windows(words[a:b], start) | np.uint64(1), start + 1, np.minimum)
        return a + np.flatnonzero(np.isin(least.view(np.int64), grams))

    return pick


def _by_halves(length: int):
    """Windows of 2 * length words of which both halves are among the row's repeated windows."""

    def pick(part: Slice, words: np.ndarray, hasher: Hasher, i: int, halves: np.ndarray) -> np.ndarray:
        return part.first[i] + halves[np.isin(halves + length, halves)]

    return pick


def _cover(window: int):
    """Per row: words left after the words of the given windows are removed, and the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at, part in hasher.slices(batch.column(2)):
                plain = np.where(part.inside, part.data, np.uint8(32))
                words = hasher.of_words(part)
                digest, removed, sha, text = [], [], [], []
                for i in range(len(part)):
                    a, b = part.first[i], part.first[i + 1]
                    pos = np.asarray(batch.column(3)[at + i].values)
                    step = np.zeros(b - a + 1, dtype=np.int64)
                    np.add.at(step, pos, 1)
                    np.add.at(step, pos + window, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    digest.append(_digest(words[a:b]))
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(_joined(part, plain, a + np.flatnonzero(~gone))).hexdigest())
                    # a removed word goes with the white space after it
                    edges = np.concatenate((part.starts[a:b], part.offsets[i + 1:i + 2]))
                    keep = np.repeat(np.concatenate(([True], ~gone)), np.diff(np.concatenate((part.offsets[i:i + 1], edges))))
                    text.append(part.data[part.offsets[i]:part.offsets[i + 1]][keep].tobytes().decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(digest, pa.binary()), pa.array(removed, pa.int64()),
                     pa.array(sha, pa.string()), pa.array(text, pa.string())],
                    names=["doc_id", "hash", "digest", "removed", "left_sha", "left_text"])

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """Windows that start in more than one document, with the smallest doc_id of each, written out so that the join can split one that very many documents have."""
    return cut(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h1", "h2", "lo"))


def removed_words(docs: DataFrame, *, window_words: int = WINDOW_WORDS, start_words: int = START_WORDS) -> tuple[DataFrame, DataFrame]:
    """What goes from each row of ``docs`` (doc_id, text): two tables.

    * (doc_id, hash, digest, n_words, first, sha): one row for each input row; ``hash``
      is its text's, ``digest`` names its word sequence, ``first`` is the smallest doc_id with it (null below
      ``window_words`` words), ``sha`` the SHA-256 of its words joined by a space;
    * (doc_id, hash, digest, removed, left_sha, left_text): for each first document of a
      sequence of which a part goes, what is left.
    """
    lengths = [start_words]
    while lengths[-1] < window_words:
        lengths.append(2 * lengths[-1])
    if len(lengths) < 2 or lengths[-1] != window_words:
        raise ValueError("window_words must be start_words doubled at least once")
    signed = cut(text_rows(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(
        _signatures(start_words), "doc_id long, hash long, n_words long, digest binary, sha string, anchors array<long>"))
    long_rows = signed.filter((F.col("n_words") >= window_words) & F.col("doc_id").isNotNull())
    firsts = cut(long_rows.groupBy("digest").agg(F.min("doc_id").alias("first")))

    ids = cut(firsts.select(F.col("first").alias("doc_id")).distinct())
    anchors = only(signed.select("doc_id", "anchors"), ids).select("doc_id", F.explode("anchors").alias("gram"))
    # cut, so that the join has an exchange on both sides and can split a gram that very many documents have
    common = cut(anchors.groupBy("gram").agg(F.count("*").alias("rows")).filter("rows > 1").select("gram"))
    hints = cut(anchors.join(common, "gram", "left_semi").groupBy("doc_id").agg(F.collect_set("gram").alias("hints")))
    texts = only(text_rows(docs), cut(hints.select("doc_id"))).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    # different texts under one doc_id are told apart by a number
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    texts = cut(texts.select("doc_id", number.alias("part"), "text").join(hints, "doc_id").select("doc_id", "part", "text", "hints"))

    length, pick, rows = 2 * start_words, _by_grams(start_words), texts
    while True:
        found = rows.mapInArrow(_windows(length, pick), "doc_id long, part int, h1 array<long>, h2 array<int>, pos array<int>")
        found = found.select("doc_id", "part", F.explode(F.arrays_zip("h1", "h2", "pos")).alias("w")).select("doc_id", "part", "w.*")
        both = found.join(_repeated(found), ["h1", "h2"])
        if length == window_words:
            break
        # go on with twice the length where windows are repeated
        places = both.groupBy("doc_id", "part").agg(F.collect_set("pos").alias("hints"))
        rows = cut(texts.drop("hints").join(places, ["doc_id", "part"]).select("doc_id", "part", "text", "hints"))
        pick, length = _by_halves(length), 2 * length
    gone = both.filter("doc_id > lo").groupBy("doc_id", "part").agg(F.collect_set("pos").alias("pos"))
    left = texts.drop("hints").join(gone, ["doc_id", "part"]).select("doc_id", F.xxhash64("text").alias("hash"), "text", "pos").mapInArrow(
        _cover(window_words), "doc_id long, hash long, digest binary, removed long, left_sha string, left_text string")
    named = signed.select("doc_id", "hash", "digest", "n_words", "sha").join(firsts, "digest", "left")
    return named.select("doc_id", "hash", "digest", "n_words", F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"), "sha"), left


_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def substring_report(docs: DataFrame, *, window_words: int = WINDOW_WORDS, start_words: int = START_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    A word goes if a window of ``window_words`` words that covers it also starts in a
    row with a smaller doc_id; windows are those of the input. Words are runs outside
    space and ``\\t\\n\\v\\f\\r``, unchanged. A null text has no words. A row without a
    doc_id neither loses words nor takes any. Rows with the same doc_id take nothing
    from each other. Texts below ``window_words`` words are whole; an empty table
    gives an empty result; other columns are not read.
    """
    rows, left = removed_words(docs, window_words=window_words, start_words=start_words)
    copy = F.col("first") < F.col("doc_id")
    return rows.join(left.select("doc_id", "digest", "removed", "left_sha").distinct(), ["doc_id", "digest"], "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, window_words: int = WINDOW_WORDS, start_words: int = START_WORDS) -> DataFrame:
    """``docs`` without the words that ``substring_report`` counts as removed, and n_chars, where there is one, counted anew.

    A removed word goes with the white space after it; the rest of the text stays as
    it is. A text that loses every word becomes empty. All rows and columns stay.
    """
    rows, left = removed_words(docs, window_words=window_words, start_words=start_words)
    copies = rows.filter("first < doc_id").select("doc_id", "hash", F.lit("").alias("left_text"))
    changes = left.select("doc_id", "hash", "left_text").unionByName(copies).dropDuplicates(["doc_id", "hash"])
    changes = changes.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("left_text").alias("__left"))
    joined = docs.join(changes, (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hash")), "left")
    changed = {"text": F.coalesce("__left", docs["text"].cast("string"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__left").isNotNull(), F.length("__left").cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])
