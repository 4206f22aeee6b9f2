"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct shingle hashes (63 bits,
so that Spark's signed order is theirs). Sketches of parts merge to the sketch of
the whole; fewer than k values mean that the set is known exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.tables import text_rows
from txnlens.llm.words import Hasher

K = 128
SHINGLE_WORDS = 5

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, containment double, n_distinct double")


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct 64-bit hashes, as 63-bit values."""
    return np.unique(hashes[: 2 * k + 2] >> np.uint64(1))[:k].astype(np.int64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of the sets behind two sketches."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact when both sets are known whole. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) >= k or len(b) >= k:
        union = union[:k]
    both = len(np.intersect1d(a, b, assume_unique=True)) if len(a) < k and len(b) < k else int(
        np.isin(union, a, assume_unique=True).astype(int) @ np.isin(union, b, assume_unique=True).astype(int))
    return both / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((int(a[k - 1]) + 1) / 2.0**63)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's set that lies in b's; 0 for an empty a."""
    if not len(a):
        return 0.0
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct(a, k) + distinct(b, k))
    return min(1.0, shared / distinct(a, k))


def encode(a: np.ndarray) -> str:
    """A sketch as text: base64 of its big-endian 64-bit values."""
    return base64.b64encode(a.astype(">i8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype=">i8").astype(np.int64)


def sketches(texts: pa.Array, hasher: Hasher, k: int = K, shingle: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sketch of every text of an Arrow column."""
    out = []
    for _, part in hasher.slices(texts):
        words = hasher.of_words(part)
        out += [bottom_k(hasher.shingles(words[a:b], shingle), k) for a, b in zip(part.first[:-1], part.first[1:], strict=True)]
    return out


def document_sketches(docs: DataFrame, *, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, sketch array<long>) of every row of ``docs`` (doc_id, text).

    A-Z reads as a-z. A null or wordless text gives an empty array, a text of fewer
    words than a shingle is one shingle, a null doc_id is passed on, repeated rows
    give equal sketches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [s.tolist() for s in sketches(batch.column(1), hasher, k, shingle_words)], pa.list_(pa.int64()))],
                names=["doc_id", "sketch"])

    return text_rows(docs).mapInArrow(run, "doc_id long, sketch array<long>")


def merge_sketches(parts: DataFrame, key: str, *, k: int = K, salts: int = 64) -> DataFrame:
    """One (key, sketch) from the sketches of its parts; null sketches count as empty.

    Works on the distinct values of each key, so copies end where they are read, in
    two steps: over groups salted by the value (at least ``salts``, and as many as there
    are shuffle partitions) and then over keys. Each step keeps k values a group, and no
    more are ever gathered in an array.
    """
    salts = max(salts, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = parts.select(F.col(key).alias("k"), F.explode_outer("sketch").alias("s")).distinct().withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(salts)))
    for group in (["k", "salt"], ["k"]):
        values = values.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("s").asc_nulls_last()))).filter(F.col("n") <= k)
    return values.groupBy("k").agg(F.sort_array(F.collect_list("s")).alias("sketch")).select(F.col("k").alias(key), "sketch")


#: Fine ranges counted for each range that is made, and how many there are at most where the ranges are fewer.
FINE, MOST_FINE = 16, 4096


def _above(cuts: list[int], key: Column) -> Column:
    """How many of the ascending ``cuts`` are larger than ``key``, by bisection: a few steps a row, however many cuts."""
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")  # one literal, folded once
    # the largest number of cuts that are not above the key
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= len(cuts)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))
    return F.lit(len(cuts)) - below


def _ranges(rows: DataFrame, n: int) -> list[int]:
    """At most n - 1 values of ``at`` (ascending) that cut the rows into ranges of about equal work.

    Counts rows and bytes of text of finer ranges of about equally many rows, and
    closes a range when its share of both is reached, so that neither long texts nor
    very many short ones gather in a range.
    """
    if n < 2:
        return []
    m = max(n, min(FINE * n, MOST_FINE))
    points = rows.agg(F.percentile_approx("at", [i / m for i in range(1, m)], 10 * m)).first()[0]
    fine = sorted(set(points or ()))
    sizes = {r["fine"]: (r["rows"], r["bytes"]) for r in rows.groupBy(_above(fine, F.col("at")).alias("fine")).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    all_rows, all_bytes = (max(1, sum(v[i] for v in sizes.values())) for i in (0, 1))
    cuts, share = [], 0.0
    for i, point in enumerate(fine):
        # rows below this point and not below the one before
        count, size = sizes.get(len(fine) - i, (0, 0))
        own = (count / all_rows + size / all_bytes) / 2
        if share + own / 2 >= (len(cuts) + 1) / n and len(cuts) < n - 1:
            # cut before or after this fine range, whichever is nearer the share
            cuts.append(fine[i - 1] if i else point)
        share += own
    return sorted(set(cuts))


def fingerprint_edits(docs: DataFrame, *, k: int = K, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited copy, and their likeness.

    The edited copy replaces the last floor(n/2) code points with the first as many
    of the next document by descending doc_id (after the last: the first). Rows are
    dealt out by doc_id range, one task a range, and read in order, holding one row back; the row after
    a range's last one is its successor's first, added to the range beforehand (one
    row a range, found by key). containment is the estimated share of the text's
    shingles that the edited text has, n_distinct the estimated number of the text's. Null text reads as empty; null doc_ids follow the
    smallest doc_id; rows that share a doc_id are ordered by text; a single row
    follows itself; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # null ids stand below all others
    lowest = -(1 << 63)
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(lowest)))
    cuts = _ranges(rows, n)
    # range 0 has the largest doc_ids
    rows = rows.withColumn("part", _above(cuts, F.col("at")))
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.max("at").alias("head")).collect())
    after = [(p, heads[(i + 1) % len(heads)][1]) for i, (p, _) in enumerate(heads)]
    first = (rows.filter(F.col("at").isin([h for _, h in heads])).groupBy("at").agg(F.min("text").alias("text")))
    links = spark.createDataFrame(after, "part int, at long")
    ends = links.join(first, "at").select(
        F.lit(None).cast("long").alias("doc_id"), "text", "at", "part", F.lit(1).alias("extra"))
    dealt = (rows.withColumn("extra", F.lit(0)).unionByName(ends).repartitionById(len(cuts) + 1, "part")
             .sortWithinPartitions("part", "extra", F.desc("at"), "text").select("part", "extra", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        held: list = []
        for batch in batches:
            texts = batch.column(3)
            for at, piece in hasher.slices(texts):
                size = len(piece)
                new = list(zip(*(batch.column(c).slice(at, size).to_pylist() for c in range(4)),
                               sketches(texts.slice(at, size), hasher, k, shingle_words), strict=True))
                queue = held + new
                # an added row ends its range: it is never a document of its own
                pairs = [(a, b) for a, b in zip(queue[:-1], queue[1:], strict=True) if not a[1]]
                held = queue[-1:]
                if not pairs:
                    continue
                edited = [t[: len(t) - len(t) // 2] + nxt[3][: len(t) // 2] for (_, _, _, t, _), nxt in pairs]
                edits = sketches(pa.array(edited, pa.large_string()), hasher, k, shingle_words)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([encode(a[4]) for a, _ in pairs]), pa.array([encode(e) for e in edits]),
                    pa.array([resemblance(a[4], e, k) for (a, _), e in zip(pairs, edits, strict=True)], pa.float64()),
                    pa.array([resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
                    pa.array([containment(a[4], e, k) for (a, _), e in zip(pairs, edits, strict=True)], pa.float64()),
                    pa.array([distinct(a[4], k) for a, _ in pairs], pa.float64())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.mapInArrow(run, SCHEMA)
