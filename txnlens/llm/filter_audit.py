"""Filter interaction audit: what five filters remove in each of their 120 orders.

Every document becomes a mask of the filters it fails. Equal masks of a part (a
language) are counted into at most 32 cells, and only cells go through the orders:
the array of all orders is a literal that travels with the plan, ``transform`` runs
over it and ``aggregate`` folds each order's five steps, so a cell gives 600 structs
weighted by its counts. The arrays of a part's cells are merged element by element.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filter letters; bit i of a mask is set if a document fails filter i.
FILTERS = "ABCDE"
#: Filter E, which compares a text with the others; the rest look at one text only.
_SAME_TEXT = FILTERS.index("E")
_SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column, *, min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> list[Column]:
    """Does a (non-null) text fail A, B, C and D?

    A: under ``min_words`` words. B: distinct words below ``distinct_percent`` of the
    words. C: more than ``capital_percent`` of the code points are A-Z. D: holds one
    of ``# $ % & * |``. Words are case-sensitive runs outside space and ``\\t-\\r``.
    """
    words = F.array_remove(F.split(text, _SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [n < min_words, 100 * distinct < distinct_percent * n,
            100 * F.regexp_count(text, F.lit("[A-Z]")) > capital_percent * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, *, part: str = "lang", **limits) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each part counted by the filters they fail and their labels.

    Texts are read and hashed once; beyond the scan only ids, hashes and masks move.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = failures(text, **limits)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"),
        reduce(lambda a, b: a + b, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]).alias("mask"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    about = ["part", "same", "mask", "good", "toxic"]
    marked = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    # repeated rows first (the join has dealt them by doc_id), then copies: a group of any size is a row a task
    copies = marked.groupBy("doc_id", *about).agg(F.count("*").alias("n"))
    groups = copies.groupBy(*about).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
                                        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    # the smallest id of a text over all parts: its rows pass E, as do rows without an id
    first = F.min("least").over(Window.partitionBy("same"))  # of at most four rows a part
    groups = groups.withColumn("passes", F.col("no_id") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0))
    each = F.explode(F.array(F.struct(F.col("mask"), F.col("passes").alias("n")),
                             F.struct((F.col("mask") + (1 << _SAME_TEXT)).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    return (groups.select("part", "good", "toxic", each.alias("cell")).filter("cell.n > 0")
            .groupBy("part", F.col("cell.mask").alias("mask"), "good", "toxic").agg(F.sum("cell.n").alias("n")))


def _orders() -> Column:
    """All orders as a literal array of arrays of filter numbers (folded to a constant by the optimizer)."""
    return F.from_json(F.lit(str([list(o) for o in permutations(range(len(FILTERS)))])), "array<array<int>>")


def _fold(order: Column) -> Column:
    """A cell's five steps under one order, each a struct of counts."""

    def step(state: Column, f: Column) -> Column:
        fails = F.getbit("mask", f) == 1
        out = state["alive"] & fails

        def where(cond: Column, count: str = "n") -> Column:
            return F.when(cond, F.col(count)).otherwise(F.lit(0).cast("long"))

        counted = F.struct(
            f.alias("f"), where(state["alive"] & ~fails).alias("kept"), where(out).alias("removed"), where(~state["alive"] & fails).alias("redundant"),
            where(F.col("mask") == F.call_function("shiftleft", F.lit(1), f)).alias("unique_fails"),
            where(out, "good").alias("good_lost"), where(out, "toxic").alias("toxic_lost"))
        return F.struct((state["alive"] & ~fails).alias("alive"), F.concat(state["steps"], F.array(counted)).alias("steps"))

    steps = "array<struct<f:int," + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>"
    return F.aggregate(order, F.struct(F.lit(True).alias("alive"), F.array().cast(steps).alias("steps")), step, lambda s: s["steps"])


def _sum_elements(arrays: Column) -> Column:
    """The elementwise sum of arrays of structs that agree in ``f``."""
    return F.aggregate(F.slice(arrays, 2, F.size(arrays)), F.element_at(arrays, 1), lambda total, one: F.zip_with(
        total, one, lambda a, b: F.struct(a["f"].alias("f"), *[(a[c] + b[c]).alias(c) for c in _COUNTS])))


def _removed_by(f: int) -> Column:
    """What filter ``f`` removes, summed over the steps of all orders."""
    return F.aggregate("steps", F.lit(0).cast("long"), lambda total, s: total + F.when(s["f"] == f, s["removed"]).otherwise(0))


def filter_audit(docs: DataFrame, labels: DataFrame, *, part: str = "lang", **limits) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step.

    ``docs`` has doc_id, text and ``part``; ``labels`` has doc_id, quality and toxic.
    A null text is empty; a null part is the empty string. E fails if a smaller doc_id
    has the same text (told by SHA-256) in any part; repeated rows of one doc_id don't
    fail for each other, and a row without doc_id neither fails E nor makes others
    fail. A document is good (toxic) if any of its label rows has quality (toxic) 1;
    without one, neither. Each row counts. A part has all of its 600 rows, zeros
    included; an empty table gives none. Other columns are not read.
    """
    cells = masks(docs, labels, part=part, **limits).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    folded = cells.select("part", F.flatten(F.transform(_orders(), _fold)).alias("steps"))
    # at most 32 arrays of 600 a part
    merged = folded.groupBy("part").agg(_sum_elements(F.collect_list("steps")).alias("steps"))
    by_filter = F.array(*[_removed_by(f) for f in range(len(FILTERS))])
    names = F.split(F.lit(",".join("".join(o) for o in permutations(FILTERS))), ",")
    rows = merged.withColumn("by_filter", by_filter).select("part", "by_filter", F.posexplode("steps").alias("at", "s"))
    width = len(FILTERS)
    return rows.select("part", F.element_at(names, F.floor(F.col("at") / width).cast("int") + 1).alias("filter_order"),
                       (F.col("at") % width + 1).cast("int").alias("step"), *[F.col(f"s.{c}").alias(c) for c in _COUNTS],
                       F.element_at("by_filter", F.col("s.f") + 1).alias("shapley"))
