"""Toxicity by a classifier chain.

Categories are predicted one after the other. A linear model of each reads the
text's features and the probabilities of the categories before it; those it is
trained with are out of fold, so that it learns from probabilities as good as the
ones it will get. Features are hashed words and word beginnings (three to six
characters, which words built on one stem share); of these the chain uses the ones
that set toxic texts apart, found by a chi-square test over all learning rows.

The label table has one label, toxic. Earlier categories are weak labels from it: a
toxic text with a word of a category's list has the category, a text that is not
toxic has none, and a toxic text without such a word says nothing about it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.features import held_out, learning_rows
from txnlens.llm.tables import text_rows
from txnlens.llm.words import Hasher, Slice

BITS = 20
PREFIXES = (3, 4, 5, 6)
#: Features that the chain reads.
SELECTED = 2048
#: Least number of toxic learning texts that have a feature.
LEAST_TEXTS = 3
#: Bound of the labelled sample that the chain is fitted on.
MAX_LEARNING_ROWS = 20_000
FOLDS = 3
THRESHOLD = 0.4

#: Words of the weak categories (general English terms of abuse), by category, in the chain's order.
WORD_LISTS = {
    "insult": ["idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile", "dimwit", "pathetic"],
    "contempt": ["trash", "scum", "worthless", "disgusting", "garbage", "filth", "vermin", "parasite", "subhuman", "vile"],
    "threat": ["kill", "murder", "hurt", "destroy", "die", "beat", "stab", "shoot"],
}
TARGET = "toxic"


def feature_ids(part: Slice, folded: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct hashed words and word beginnings of each row of a slice."""
    row = part.word_rows()
    n = len(part.data)
    rows, ids = [row], [folded.of_words(part) >> np.uint64(64 - BITS)]
    if len(row):
        # places of characters: the byte of the k-th character after a word's first
        begins = np.flatnonzero((part.data & 0xC0) != 0x80)
        first = np.searchsorted(begins, part.starts)
        begins = np.append(begins, np.full(max(PREFIXES) + 1, n))
        for k in PREFIXES:
            end = begins[first + k]
            has = end < part.ends
            rows.append(row[has])
            ids.append((folded.ranges(part, part.starts[has], end[has]) + np.uint64(k)) >> np.uint64(64 - BITS))
    keys = np.unique(np.concatenate(rows).astype(np.int64) << BITS | np.concatenate(ids).astype(np.int64))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def listed(text: str) -> list[bool]:
    """For each category: does the text have a word of its list (punctuation at a word's ends aside)?"""
    words = {w.strip(".,;:!?\"'()[]*#$%&|-") for w in text.lower().split()}
    return [not words.isdisjoint(names) for names in WORD_LISTS.values()]


@dataclass
class Linear:
    """Logistic regression over selected features and dense inputs."""

    weight: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, start: np.ndarray, index: np.ndarray, dense: np.ndarray) -> np.ndarray:
        # each row's sum is added up from 0 in order, so that it does not depend on the rows beside it
        n = len(start) - 1
        margin = self.bias + np.bincount(np.repeat(np.arange(n), np.diff(start)), self.weight[index], minlength=n)
        for j, weight in enumerate(self.dense):
            margin = margin + dense[:, j] * weight
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    @classmethod
    def fit(cls, size: int, start: np.ndarray, index: np.ndarray, dense: np.ndarray, target: np.ndarray,
            steps: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Linear:
        """Full-batch AdaGrad on the logistic loss."""
        model = cls(np.zeros(size), np.zeros(dense.shape[1]), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))))
        square_w, square_d, square_b = np.full(size, 1e-8), np.full(dense.shape[1], 1e-8), 1e-8
        row = np.repeat(np.arange(len(target)), np.diff(start))
        for _ in range(steps):
            error = (model.probability(start, index, dense) - target) / len(target)
            grad = np.bincount(index, error[row], minlength=size) + decay * model.weight
            grad_d = error @ dense + decay * model.dense
            square_w += grad**2
            square_d += grad_d**2
            square_b += error.sum() ** 2
            model.weight -= rate * grad / np.sqrt(square_w)
            model.dense -= rate * grad_d / np.sqrt(square_d)
            model.bias -= rate * error.sum() / np.sqrt(square_b)
        return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)) / 4


@dataclass
class Chain:
    """Selected features (sorted), and a model for each category in order."""

    features: np.ndarray
    categories: list[str] = field(default_factory=list)
    models: list[Linear] = field(default_factory=list)

    def rows(self, row: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row offsets, places of the selected features) from pairs sorted by row."""
        if not len(self.features):
            return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        known = self.features[at] == feature
        return np.searchsorted(row[known], np.arange(n + 1)), at[known]

    def probabilities(self, start: np.ndarray, index: np.ndarray) -> np.ndarray:
        """One column for each category, each fed to those after it."""
        n = len(start) - 1
        out = np.zeros((n, len(self.models)))
        for j, model in enumerate(self.models):
            out[:, j] = model.probability(start, index, _logit(out[:, :j]))
        return out

    def fit(self, start: np.ndarray, index: np.ndarray, targets: dict[str, np.ndarray], fold: np.ndarray) -> None:
        """``targets`` by category in the chain's order, NaN where unknown; ``fold`` numbers the parts left out in turn.

        A category of which the known rows are all alike is left out of the chain.
        """
        fed = np.zeros((len(start) - 1, 0))
        size = max(1, len(self.features))

        def take(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = start[rows + 1] - start[rows]
            stop = np.cumsum(sizes)
            at = np.arange(stop[-1] if len(rows) else 0) + np.repeat(start[rows] - (stop - sizes), sizes)
            return np.concatenate(([0], stop)), index[at]

        for name, target in targets.items():
            known = np.flatnonzero(~np.isnan(target))
            if not len(known) or target[known].min() == target[known].max():
                continue
            out = np.zeros(len(target))
            for f in np.unique(fold):
                rows = known[fold[known] != f]
                left = np.flatnonzero(fold == f)
                if not len(rows):
                    rows = known
                model = Linear.fit(size, *take(rows), fed[rows], target[rows])
                out[left] = model.probability(*take(left), fed[left])
            self.models.append(Linear.fit(size, *take(known), fed[known], target[known]))
            self.categories.append(name)
            fed = np.concatenate((fed, _logit(out)[:, None]), axis=1)


def fit_chain(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_LEARNING_ROWS, selected: int = SELECTED) -> Chain:
    """Learn from at most ``limit`` labelled documents that are not held out; without any, the chain has no categories."""
    sample = learning_rows(labels, [TARGET], limit)
    # at most `limit` rows of two numbers, whatever the size of the tables
    rows = text_rows(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", TARGET)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = Hasher(fold=True)
        for batch in batches:
            for at, part in folded.slices(batch.column(1)):
                row, feature = feature_ids(part, folded)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)),
                    pa.array([listed(t.as_py() or "") for t in batch.column(1).slice(at, len(part))], pa.list_(pa.bool_())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))],
                    names=["doc_id", TARGET, "listed", "feature"])

    found = rows.mapInArrow(features, f"doc_id long, {TARGET} double, listed array<boolean>, feature array<int>")
    total = found.agg(F.count("*").alias("n"), F.sum(TARGET).alias("toxic")).first()
    if not total["n"] or not total["toxic"]:
        return Chain(np.zeros(0, dtype=np.int64))
    # chi-square of having the feature against being toxic, over all learning rows
    n, toxic = float(total["n"]), float(total["toxic"])
    counts = found.select(TARGET, F.explode("feature").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("texts"), F.sum(TARGET).alias("hits")).filter(F.col("hits") >= LEAST_TEXTS)
    expected = F.col("texts") * toxic / n
    chi = (F.col("hits") - expected) ** 2 / expected + (F.col("hits") - expected) ** 2 / (F.col("texts") * (n - toxic) / n + 1e-9)
    best = [r["feature"] for r in counts.filter(F.col("hits") > expected).orderBy(chi.desc(), "feature").limit(selected).collect()]
    chain = Chain(np.array(sorted(best), dtype=np.int64))
    wanted = F.array(*map(F.lit, best)).cast("array<int>") if best else F.array().cast("array<int>")
    got = found.select("doc_id", TARGET, "listed", F.array_intersect("feature", wanted).alias("feature")).toArrow().sort_by("doc_id").combine_chunks()
    target, known = got[TARGET].to_numpy(), np.array(got["listed"].to_pylist(), dtype=bool)
    lists = [np.sort(np.asarray(x.values)) for x in got["feature"]]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    start, index = chain.rows(row, np.concatenate(lists).astype(np.int64), len(lists))
    targets = {name: np.where(target < 0.5, 0.0, np.where(known[:, j], 1.0, np.nan)) for j, name in enumerate(WORD_LISTS)}
    targets[TARGET] = (target >= 0.5).astype(float)
    chain.fit(start, index, targets, got["doc_id"].to_numpy() % FOLDS)
    return chain


def score_toxicity(docs: DataFrame, chain: Chain, *, threshold: float = THRESHOLD) -> DataFrame:
    """Probabilities of every row of ``docs`` (doc_id, text): doc_id, held_out, one column p_<category> each, score, toxic.

    score is the probability of the last category, toxic (0 or 1) whether it reaches
    ``threshold``. A category that could not be learned has probability 0. A null text
    is an empty one; a null doc_id is passed on; repeated rows score alike, bit for bit,
    wherever they stand; an empty table gives an empty result; other columns are not read.
    """
    names = [*WORD_LISTS, TARGET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded = Hasher(fold=True)
        for batch in batches:
            for at, part in folded.slices(batch.column(1)):
                row, feature = feature_ids(part, folded)
                p = chain.probabilities(*chain.rows(row, feature, len(part)))
                columns = {c: p[:, j] for j, c in enumerate(chain.categories)}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *[pa.array(columns.get(c, np.zeros(len(part)))) for c in names]],
                    names=["doc_id", *[f"p_{c}" for c in names]])

    scored = text_rows(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in names))
    return scored.select("doc_id", held_out().alias("held_out"), *[f"p_{c}" for c in names], F.col(f"p_{TARGET}").alias("score"),
                         (F.col(f"p_{TARGET}") >= threshold).cast("int").alias("toxic"))
