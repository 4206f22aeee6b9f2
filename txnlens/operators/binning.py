"""Right-closed binning with labelled, possibly empty, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.schemas import CREDIT_EDGES, CREDIT_LABELS


def _bins(c, edges, values) -> Column:
    """``values[i]`` where edges[i] < c <= edges[i+1]; null outside (also at edges[0])."""
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for lo, hi, v in zip(edges[:-1], edges[1:], values):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def band_index(c, edges=CREDIT_EDGES) -> Column:
    """0-based bin of ``c`` for right-closed bins; null outside."""
    return _bins(c, edges, range(len(edges) - 1))


def band_label(c, edges=CREDIT_EDGES, labels=CREDIT_LABELS) -> Column:
    """Label of the right-closed bin of ``c``; null outside."""
    return _bins(c, edges, labels)


def cut_counts(df: DataFrame, column: str, edges=CREDIT_EDGES, labels=CREDIT_LABELS,
               label_name: str = "band") -> DataFrame:
    """Rows per bin in bin order; bins without rows are kept with count 0.

    Counting is one aggregation on the bin index (at most len(labels) groups);
    the fixed list of bins is generated with ``range`` and left-joined to it.
    """
    counts = (df.select(band_index(column, edges).alias("band_order"))
              .filter(F.col("band_order").isNotNull())
              .groupBy("band_order").agg(F.count(F.lit(1)).alias("count")))
    spark = df.sparkSession
    bands = spark.range(len(labels)).select(
        F.col("id").cast("int").alias("band_order"),
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("id").cast("int") + 1).alias(label_name),
    )
    # both sides hold at most len(labels) rows
    return (bands.join(F.broadcast(counts), "band_order", "left")
            .select("band_order", label_name, F.coalesce(F.col("count"), F.lit(0)).alias("count"))
            .orderBy("band_order"))


def credit_bands(users: DataFrame) -> DataFrame:
    return cut_counts(users, "credit_score", label_name="credit_band")
