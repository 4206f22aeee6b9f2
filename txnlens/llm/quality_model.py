"""Quality classifier: a second-order factorisation machine.

Inputs are hashed words (unit-length log counts), structure statistics and the
text's size. Each input has a weight and a short vector; the score adds the weights
and, for each pair of inputs, the product of their vectors, which the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2 gives in
time linear in the inputs. Learned by logistic loss and AdaGrad on a bounded sample
of labelled rows; labels, language, source and ids are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.features import STRUCTURE, held_out, learning_rows, structure, word_counts
from txnlens.llm.tables import text_rows
from txnlens.llm.words import Hasher, Slice

WORD_BITS = 15
FACTORS = 8
#: Bound of the labelled sample that the model is fitted on.
MAX_LEARNING_ROWS = 12_000
EPOCHS = 8
BATCH = 128
THRESHOLD = 0.3


@dataclass
class Rows:
    """Sparse inputs of some documents: row offsets, input numbers, values."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = self.start[rows + 1] - self.start[rows]
        stop = np.cumsum(size)
        at = np.arange(stop[-1], dtype=np.int32 if stop[-1] < 2**31 else np.int64)
        at += np.repeat((self.start[rows] - (stop - size)).astype(at.dtype), size)
        return Rows(np.concatenate(([0], stop)), self.index[at], self.value[at])


def _row_sums(start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x`` between offsets, each added up from 0 in order, so that they do not depend on the rows beside them."""
    n = len(start) - 1
    row = np.repeat(np.arange(n), np.diff(start))
    if x.ndim == 1:
        return np.bincount(row, x, minlength=n)
    return np.stack([np.bincount(row, x[:, k], minlength=n) for k in range(x.shape[1])], axis=1)


def _across(x: np.ndarray) -> np.ndarray:
    """The sum of the columns, added from left to right."""
    total = x[:, 0].copy()
    for k in range(1, x.shape[1]):
        total += x[:, k]
    return total


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def inputs(self, part: Slice, raw: Hasher, folded: Hasher) -> Rows:
        """Hashed words, then the structure statistics in standard units."""
        start, index, value = word_counts(part, folded, WORD_BITS)
        dense = np.clip((structure(part, raw) - self.centre) / self.scale, -4, 4)
        n, width = dense.shape
        size = np.diff(start)
        ends = np.cumsum(size + width)
        begin = ends - size - width
        out_index, out_value = np.empty(ends[-1] if n else 0, dtype=np.int64), np.empty(ends[-1] if n else 0)
        words = np.arange(len(index)) + np.repeat(begin - start[:-1], size)
        out_index[words], out_value[words] = index, value
        stats = (begin + size)[:, None] + np.arange(width)
        out_index[stats], out_value[stats] = (1 << WORD_BITS) + np.arange(width), dense / 2
        return Rows(np.concatenate(([0], ends)), out_index, out_value)

    def margin(self, rows: Rows) -> np.ndarray:
        vx = self.factor[rows.index] * rows.value[:, None]
        sums = _row_sums(rows.start, vx)
        pairs = 0.5 * (_across(sums**2) - _row_sums(rows.start, _across(vx**2)))
        return self.bias + _row_sums(rows.start, self.weight[rows.index] * rows.value) + pairs

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))

    def fit(self, rows: Rows, target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, seed: int = 0) -> None:
        """AdaGrad on the logistic loss; ``target`` lies in 0..1."""
        random = np.random.default_rng(seed)
        square_w, square_v, square_b = np.full_like(self.weight, 1e-6), np.full_like(self.factor, 1e-6), 1e-6
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                chosen = order[at:at + BATCH]
                part = rows.take(chosen)
                error = (self.score(part) - target[chosen]) / len(chosen)
                row = np.repeat(np.arange(len(part)), np.diff(part.start))
                used, place = np.unique(part.index, return_inverse=True)
                vx = self.factor[part.index] * part.value[:, None]
                slope = (error[row] * part.value)[:, None] * (_row_sums(part.start, vx)[row] - vx)
                grad_w = np.bincount(place, error[row] * part.value) + decay * self.weight[used]
                grad_v = np.stack([np.bincount(place, slope[:, k]) for k in range(slope.shape[1])], axis=1) + decay * self.factor[used]
                square_w[used] += grad_w**2
                square_v[used] += grad_v**2
                square_b += error.sum() ** 2
                self.weight[used] -= rate * grad_w / np.sqrt(square_w[used])
                self.factor[used] -= rate / 2 * grad_v / np.sqrt(square_v[used])
                self.bias -= rate * error.sum() / np.sqrt(square_b)


def _blank(centre: np.ndarray, scale: np.ndarray, seed: int = 0) -> FactorisationMachine:
    size = (1 << WORD_BITS) + len(STRUCTURE)
    return FactorisationMachine(0.0, np.zeros(size), np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS)), centre, scale)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", limit: int = MAX_LEARNING_ROWS) -> FactorisationMachine:
    """Learn from at most ``limit`` labelled documents; held-out rows are never used.

    Without labelled rows the model gives every text 0.5.
    """
    sample = learning_rows(labels, [label], limit)
    # the sample has at most `limit` rows of two numbers, whatever the size of the tables
    rows = text_rows(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col(label).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, folded = Hasher(), Hasher(fold=True)
        for batch in batches:
            for at, part in raw.slices(batch.column(1)):
                start, index, value = word_counts(part, folded, WORD_BITS)
                stats = structure(part, raw)
                ends = pa.array(start.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)),
                    pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32))), pa.array(stats.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "target", "bucket", "value", "stats"])

    got = rows.mapInArrow(run, "doc_id long, target double, bucket array<int>, value array<float>, stats array<double>").toArrow()
    if not got.num_rows:
        model = _blank(np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)))
        model.factor[:] = 0
        return model
    # as few and as small copies of the sample as can be: it is the largest thing the driver holds
    got = got.combine_chunks()
    stats = got["stats"].chunk(0).flatten().to_numpy().reshape(-1, len(STRUCTURE))
    model = _blank(stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    dense = (np.clip((stats - model.centre) / model.scale, -4, 4) / 2).astype(np.float32)
    words = got["bucket"].chunk(0)
    size = np.diff(words.offsets.to_numpy())
    ends = np.cumsum(size + dense.shape[1])
    begin = ends - size - dense.shape[1]
    index, value = np.empty(ends[-1], dtype=np.int32), np.empty(ends[-1], dtype=np.float32)
    of_words = np.ones(len(index), dtype=bool)
    for j in range(dense.shape[1]):
        at = begin + size + j
        of_words[at], index[at], value[at] = False, (1 << WORD_BITS) + j, dense[:, j]
    index[of_words], value[of_words] = words.flatten().to_numpy(), got["value"].chunk(0).flatten().to_numpy()
    order, target = np.argsort(got["doc_id"].to_numpy(), kind="stable"), got["target"].to_numpy()
    del got, words, of_words
    model.fit(Rows(np.concatenate(([0], ends)), index, value).take(order), target[order])
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    A null text is an empty one, which has a score too; a null doc_id is passed on
    (not held out); repeated rows score alike, bit for bit, wherever they stand; an empty table gives an empty result;
    other columns are not read. The model is a bounded table sent with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, folded = Hasher(), Hasher(fold=True)
        for batch in batches:
            for at, part in raw.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(model.score(model.inputs(part, raw, folded)))], names=["doc_id", "score"])

    scored = text_rows(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: FactorisationMachine, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``.

    ``docs`` has a column ``text``; a null text is scored as an empty one, repeated rows
    stay or go together, and an empty table gives an empty result.
    """
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, folded = Hasher(), Hasher(fold=True)
        for batch in batches:
            for at, part in raw.slices(batch.column(text)):
                yield batch.slice(at, len(part)).filter(pa.array(model.score(model.inputs(part, raw, folded)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
