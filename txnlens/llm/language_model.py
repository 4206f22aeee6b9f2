"""Language-model scoring: a log-bilinear model over the corpus's own word counts.

Three passes over the texts. The first counts every word of the training documents
(a shuffle by word). The second fits the model, and covers all training documents
too: every task trains a copy on its own documents, and the copies are averaged,
weighted by their tokens. The third scores all documents.

The model's symbols are the most frequent words, classes of the other words by their
last two bytes, and the end of a text. It predicts a symbol's vector from those of
the symbols before it, r = sum_j C_j * R[w_j] with diagonal C_j, and scores symbol s
by <r, Q[s]> + b[s]. Noise-contrastive estimation fits it without a normaliser:
logistic regression tells true symbols from shared noise symbols of the unigram
distribution. Scores are normalised over all symbols by matrix products, each
context once a task. A word of a class has its class's probability times its share of
the class's counts, smoothed like the base score.

Words are told apart by 64-bit hashes. Counts of frequent words, a bounded number,
travel with the tasks; those of rarer words are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.features import held_out
from txnlens.llm.tables import cut, text_rows
from txnlens.llm.words import Hasher, Slice, mix

FOLDS = 10
ALPHA = 0.1
#: Words that are symbols of their own, classes of the others, size of a vector, symbols of context.
WORDS, CLASSES, WIDTH, CONTEXT = 767, 256, 32, 2
#: Least and most tokens of a step (it grows with the tokens that a task has seen, by GROWTH), noise symbols of a step, step size.
LEAST, BATCH, GROWTH, NOISE, RATE = 64, 4096, 1 / 256, 64, 0.15
#: Bound on the words whose counts travel with the tasks (16 bytes each).
FREQUENT = 1 << 18
#: Distinct words that a counting task holds before it hands them on.
HELD = 1 << 20
#: Tokens that a training task gathers and goes through in random order.
WAITING = 1 << 15
#: Contexts of one matrix product.
ROWS = 512
#: Scores are products of vectors on a grid of 1/GRID. Below 2**24 / GRID**2 = 256 they are exact in 32-bit floats
#: in any order of summation, so a text's score does not depend on the rows beside it.
GRID = 256


def word_class(part: Slice, classes: int = CLASSES) -> np.ndarray:
    """The class of each word, by its last two bytes (A-Z read as a-z)."""
    if not len(part.starts):
        return np.zeros(0, dtype=np.int64)
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    last, before = fold[part.data[part.ends - 1]], fold[part.data[np.maximum(part.ends - 2, part.starts)]]
    return (mix(last << np.uint64(8) | before) % np.uint64(classes)).astype(np.int64)


def _merged(hashes: list, classes: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return words, np.concatenate(classes)[at], np.bincount(inverse, np.concatenate(counts), minlength=len(words)).astype(np.int64)


def count_words(docs: DataFrame, classes: int = CLASSES, held: int = HELD) -> DataFrame:
    """(word, class, n): the words of all texts as hashes with their counts; class -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        waiting: tuple[list, list, list] = ([], [], [])
        texts = size = 0

        def rows(words, kinds, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(kinds, pa.int32()), pa.array(counts, pa.int64())], names=["word", "class", "n"])

        for batch in batches:
            texts += batch.num_rows
            for _, part in hasher.slices(batch.column(1)):
                words, at, n = np.unique(hasher.of_words(part), return_index=True, return_counts=True)
                for to, x in zip(waiting, (words, word_class(part, classes)[at], n), strict=True):
                    to.append(x)
                size += len(words)
                if size > 2 * held:
                    now = _merged(*waiting)
                    if len(now[0]) > held:
                        yield rows(*now)
                        now = tuple(x[:0] for x in now)
                    waiting, size = tuple([x] for x in now), len(now[0])
        if texts:
            yield rows(*_merged(*waiting))
            yield rows(np.zeros(1, dtype=np.uint64), np.array([-1]), np.array([texts]))

    return text_rows(docs).mapInArrow(run, "word long, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What the counts say: totals, class totals, and the counts of frequent words sorted by hash."""

    tokens: int
    distinct: int
    texts: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    #: Hashes of the words that are symbols, sorted, and their counts.
    own: np.ndarray
    own_counts: np.ndarray
    #: Counts from here on are among ``words``.
    least: int

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + ALPHA * (self.distinct + 1)))

    def class_log_total(self) -> np.ndarray:
        """log10 of each class's smoothed total, own symbols left out; one unseen word counts too."""
        return np.log10(self.class_tokens + ALPHA * (self.class_distinct + 1))


def read_counts(counted: DataFrame, *, words: int = WORDS, classes: int = CLASSES, frequent: int = FREQUENT) -> Counts:
    """Bounded extracts of the counts: a row a class, a row a power of two, ``words`` and at most ``frequent`` words."""
    real = counted.filter(F.col("class") >= 0)
    order = [F.desc("n"), F.asc("word")]
    own = real.orderBy(*order).limit(words).toArrow()
    tokens, distinct, texts = np.zeros(classes), np.zeros(classes), 0
    for r in counted.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        if r["class"] < 0:
            texts = r["n"]
        else:
            tokens[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    steps = real.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("least")).collect()
    least, room = 1 << 62, frequent
    for r in sorted(steps, key=lambda r: -r["step"]):
        if r["v"] > room:
            break
        least, room = r["least"], room - r["v"]
    often = real.filter(F.col("n") >= least).select("word", "n").toArrow()
    hashes = np.concatenate([x["word"].to_numpy().view(np.uint64) for x in (often, own)])
    counts = np.concatenate([x["n"].to_numpy() for x in (often, own)])
    hashes, at = np.unique(hashes, return_index=True)
    mine, order = own["word"].to_numpy().view(np.uint64), np.argsort(own["word"].to_numpy().view(np.uint64))
    kinds = own["class"].to_numpy()
    rest_tokens = tokens - np.bincount(kinds, own["n"].to_numpy(), minlength=classes)
    return Counts(int(tokens.sum()) + texts, int(distinct.sum()) + (texts > 0), texts, rest_tokens,
                  distinct - np.bincount(kinds, minlength=classes), hashes, counts[at], mine[order], own["n"].to_numpy()[order], least)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, is it there?) of each x."""
    if not len(keys):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _on_grid(x: np.ndarray) -> np.ndarray:
    return (np.rint(x * GRID) / GRID).astype(np.float32)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ``at`` in 0..n-1."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_at[1:] != sorted_at[:-1])))
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    out[sorted_at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


@dataclass
class LogBilinear:
    """Vectors of context symbols, of predicted symbols, weights of the places, biases."""

    before: np.ndarray
    after: np.ndarray
    place: np.ndarray
    bias: np.ndarray

    @classmethod
    def blank(cls, unigram: np.ndarray, width: int = WIDTH, context: int = CONTEXT, seed: int = 0) -> LogBilinear:
        """The unigram distribution and small random vectors, the same ones each time."""
        random = np.random.default_rng(seed)
        n = len(unigram)
        draw = [random.normal(0, 0.1, (n, width)).astype(np.float32) for _ in range(2)]
        return cls(*draw, np.full((context, width), 1 / context, dtype=np.float32), np.log(unigram).astype(np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.before, self.after, self.place, self.bias]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        ends = np.cumsum([p.size for p in self.parameters()])
        return LogBilinear(*[x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, ends[:-1]), self.parameters(), strict=True)])

    def predicted(self, context: np.ndarray) -> np.ndarray:
        out = self.before[context[:, 0]] * self.place[0]
        for j in range(1, context.shape[1]):
            out += self.before[context[:, j]] * self.place[j]
        return out

    def log_totals(self, context: np.ndarray) -> np.ndarray:
        """log of the normaliser after each context, ROWS contexts a matrix product."""
        out = np.empty(len(context))
        columns = np.ascontiguousarray(_on_grid(self.after).T)
        for at in range(0, len(context), ROWS):
            part = context[at:at + ROWS]
            rows = np.zeros((ROWS, self.after.shape[1]), dtype=np.float32)
            rows[:len(part)] = _on_grid(self.predicted(part))
            s = rows @ columns
            s += self.bias
            top = s.max(axis=1)
            s -= top[:, None]
            np.exp(s, out=s)
            out[at:at + ROWS] = (np.log(s.sum(axis=1).astype(np.float64)) + top)[:len(part)]
        return out

    def no_totals(self) -> np.ndarray:
        """Room for the normaliser of every context, not known yet (8 MB at the defaults)."""
        return np.full(len(self.bias) ** len(self.place), np.nan)

    def log_probabilities(self, context: np.ndarray, symbol: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of each symbol after its context; ``totals`` keeps normalisers from call to call."""
        n = len(self.bias)
        key = context[:, 0].astype(np.int64)
        for j in range(1, context.shape[1]):
            key = key * n + context[:, j]
        new = np.unique(key[np.isnan(totals[key])])
        totals[new] = self.log_totals(np.stack(np.unravel_index(new, (n,) * context.shape[1]), axis=1))
        score = np.einsum("ij,ij->i", _on_grid(self.predicted(context)), _on_grid(self.after)[symbol]) + self.bias[symbol]
        return score - totals[key]


class Trainer:
    """Noise-contrastive estimation of a LogBilinear by AdaGrad; one per task."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, noise: int = NOISE, rate: float = RATE, seed: int = 0) -> None:
        self.model = model.unpack(model.pack().copy())
        self.squares = [np.full_like(p, 1e-3) for p in self.model.parameters()]
        self.shift = np.log(noise * unigram).astype(np.float32)
        self.steps, self.noise, self.rate = np.cumsum(unigram), noise, rate
        self.random = np.random.default_rng(seed)

    def step(self, context: np.ndarray, symbol: np.ndarray) -> None:
        """One step on some tokens: true symbols against the same noise symbols for all of them."""
        m, n = self.model, len(self.shift)
        noise = np.minimum(np.searchsorted(self.steps, self.random.random(self.noise)), n - 1)
        r, true = m.predicted(context), m.after[symbol]
        score = np.einsum("ij,ij->i", r, true) + (m.bias - self.shift)[symbol]
        wrong = -1 / (1 + np.exp(np.clip(score, -30, 30)))
        wrong_noise = r @ m.after[noise].T
        wrong_noise += (m.bias - self.shift)[noise]
        np.clip(wrong_noise, -30, 30, out=wrong_noise)
        np.negative(wrong_noise, out=wrong_noise)
        np.exp(wrong_noise, out=wrong_noise)
        wrong_noise += 1
        np.reciprocal(wrong_noise, out=wrong_noise)
        back = wrong[:, None] * true + wrong_noise @ m.after[noise]
        after = _sums(wrong[:, None] * r, symbol, n)
        np.add.at(after, noise, wrong_noise.T @ r)
        bias = np.bincount(symbol, wrong, minlength=n) + np.bincount(noise, wrong_noise.sum(axis=0), minlength=n)
        before, place = np.zeros_like(m.before), np.empty_like(m.place)
        for j in range(context.shape[1]):
            before += _sums(back * m.place[j], context[:, j], n)
            place[j] = np.einsum("ij,ij->j", back, m.before[context[:, j]])
        for p, s, g in zip(m.parameters(), self.squares, (before, after, place, bias.astype(np.float32)), strict=True):
            g /= len(symbol)
            s += g * g
            p -= self.rate * g / np.sqrt(s)


    def steps_over(self, parts: list[tuple[np.ndarray, np.ndarray]], seen: int, batch_size: int = BATCH) -> int:
        """Steps over all tokens of some (symbol, context) parts in random order; the tokens seen, ``seen`` and these."""
        symbol, context = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, at = self.random.permutation(len(symbol)), 0
        while at < len(order):
            now = order[at:at + int(min(batch_size, max(LEAST, GROWTH * (seen + at))))]
            self.step(context[now], symbol[now])
            at += len(now)
        return seen + len(order)


class Symbols:
    """Texts as symbols: own words, then classes, then the end of a text."""

    def __init__(self, own: np.ndarray, classes: int, context: int) -> None:
        self.own, self.classes, self.context = own, classes, context
        self.end = len(own) + classes

    def of(self, part: Slice, words: np.ndarray) -> np.ndarray:
        at, there = _find(self.own, words)
        return np.where(there, at, len(self.own) + word_class(part, self.classes))

    def stream(self, part: Slice, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, row, context) of each token of the rows; an end follows each row, and ends stand before it."""
        n = np.diff(part.first)
        symbol = np.insert(self.of(part, words), part.first[1:], self.end)
        row = np.repeat(np.arange(len(part)), n + 1)
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
        context = np.full((len(symbol), self.context), self.end, dtype=np.int32)
        for j in range(self.context):
            at = np.flatnonzero(place > j)
            context[at, j] = symbol[at - j - 1]
        return symbol, row, context


def _unigram(counts: Counts) -> np.ndarray:
    n = np.concatenate((counts.own_counts, counts.class_tokens, [counts.texts])) + ALPHA
    return n / n.sum()


def _averaged(copies: DataFrame, groups: int) -> np.ndarray | None:
    """The mean of the copies, weighted by their tokens: summed in groups by streaming tasks, then over groups (a copy each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for tokens, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                total, n = part if total is None else total + part, n + tokens
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["tokens", "sums"])

    got = copies.repartition(groups, "task").select("tokens", "sums").mapInArrow(run, "tokens long, sums binary").collect()
    if not got:
        return None
    return sum(np.frombuffer(r["sums"], dtype=np.float64) for r in sorted(got, key=lambda r: (r["tokens"], r["sums"]))) / sum(r["tokens"] for r in got)


def fit_log_bilinear(docs: DataFrame, counts: Counts, *, classes: int = CLASSES, width: int = WIDTH, context: int = CONTEXT,
                     batch_size: int = BATCH, noise: int = NOISE, rate: float = RATE) -> LogBilinear:
    """Fit on all texts of ``docs``; without any the model is the smoothed unigram distribution."""
    unigram = _unigram(counts)
    start = LogBilinear.blank(unigram, width, context)
    symbols = Symbols(counts.own, classes, context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold=True)
        task = TaskContext.get().partitionId()
        trainer, seen = Trainer(start, unigram, noise, rate, seed=task), 0
        waiting: list = []
        size = 0
        for batch in batches:
            for _, part in hasher.slices(batch.column(1)):
                symbol, _, before = symbols.stream(part, hasher.of_words(part))
                waiting.append((symbol, before))
                size += len(symbol)
                if size >= WAITING:
                    seen, waiting, size = trainer.steps_over(waiting, seen, batch_size), [], 0
        if size:
            seen = trainer.steps_over(waiting, seen, batch_size)
        if seen:
            flat = trainer.model.pack().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([seen]), pa.array([flat.tobytes()], pa.binary())],
                                             names=["task", "tokens", "sums"])

    copies = text_rows(docs).mapInArrow(run, "task int, tokens long, sums binary")
    flat = _averaged(copies, max(1, round(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5)))
    if flat is None:
        start.before[:] = 0
        return start
    return start.unpack(flat)


_PARTS = "doc_id long, n_tokens long, n_known long, base double, model double, rare array<long>, rare_n array<long>"


def score_language(docs: DataFrame, *, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Learns from the rows whose crc32(doc_id as text) mod 10 is not 0, all of them. A
    null text is an empty one, whose only token is its end; a row without doc_id is
    not held out, so it counts and is learned from like any other; repeated rows
    count each and score alike; without training rows the base score of every token
    is 0 and the model is flat; an empty table gives an empty result. Other columns
    are not read.
    """
    rows = text_rows(docs)
    training = rows.filter(~held_out(folds=FOLDS))
    counted = cut(count_words(training))
    counts = read_counts(counted)
    model = fit_log_bilinear(training, counts)
    symbols = Symbols(counts.own, CLASSES, model.place.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts and model travel with the task: bounded by FREQUENT and by the model's size
        hasher = Hasher(fold=True)
        log_count, class_total = np.log10(counts.counts + alpha), counts.class_log_total()
        log_end = np.log10(counts.texts + alpha)
        n_own, totals = len(symbols.own), model.no_totals()
        for batch in batches:
            for at, part in hasher.slices(batch.column(1)):
                words = hasher.of_words(part)
                symbol, row, context = symbols.stream(part, words)
                chance = model.log_probabilities(context, symbol, totals) / np.log(10)
                kind = symbol - n_own
                inside = (kind >= 0) & (symbol != symbols.end)
                chance[inside] -= class_total[kind[inside]]
                n = len(part)
                score = np.bincount(row, chance, minlength=n)
                place, known = _find(counts.words, words)
                value = np.zeros(len(words))
                value[known] = log_count[place[known]]
                word_row = part.word_rows()
                base = np.bincount(word_row, value, minlength=n)
                value[inside[symbol != symbols.end] == 0] = 0  # own symbols have no share of a class
                score += np.bincount(word_row, value, minlength=n)
                # the other words' counts are joined later
                rare, rare_n = _rare(words[~known], word_row[~known], n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(np.diff(part.first) + 1),
                     pa.array(np.bincount(word_row[known], minlength=n) + (counts.texts > 0)), pa.array(base + log_end), pa.array(score), rare, rare_n],
                    names=[c.split()[0] for c in _PARTS.split(", ")])

    parts = cut(rows.mapInArrow(run, _PARTS).withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
    seen = counted.filter((F.col("class") >= 0) & (F.col("n") < counts.least)).select("word", "n")
    log10 = F.log10(F.coalesce("n", F.lit(0)) + F.lit(alpha))
    # decimals: a sum that does not depend on the order of the rows
    of_rare = rare.join(seen, "word", "left").groupBy("row").agg(
        F.sum((F.col("times") * log10).cast("decimal(30,12)")).cast("double").alias("rare_score"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    added = F.coalesce("rare_score", F.lit(0.0))
    return parts.join(of_rare, "row", "left").select(
        "doc_id", held_out(folds=FOLDS).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base") + added - F.col("n_tokens") * F.lit(counts.log_total)).alias("base_score"),
        (F.col("model") + added).alias("score"))


def _rare(words: np.ndarray, row: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Each row's distinct words and their numbers of times, as lists."""
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(words)), dtype=bool), (words[1:] != words[:-1]) | (row[1:] != row[:-1]))))
    times = np.diff(np.concatenate((new, [len(words)])))
    ends = pa.array(np.searchsorted(row[new], np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(words[new].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))
