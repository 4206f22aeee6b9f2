"""Pearson correlation matrix with pairwise-complete rows, as long rows."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present (not null, not NaN); null when either is constant.

    ``corr`` raises on a constant column under ANSI mode; this form divides with
    ``try_divide`` instead.
    """
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column_a, column_b, r) for every ordered pair, diagonal included.

    One aggregation computes the distinct pairs (upper triangle and diagonal);
    the lower triangle is the mirror image.
    """
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                             F.col(f"p{i}").alias("r")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"),
                                 F.col(f"p{i}").alias("r")))
    return one.select(F.inline(F.array(*rows)))


def user_correlations(users: DataFrame) -> DataFrame:
    return correlation_matrix(users, ["per_capita_income", "yearly_income", "total_debt", "credit_score"])
