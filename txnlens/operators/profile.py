"""Table profiling: shape, column info, head, null counts, duplicates, describe.

Every profile is a single aggregation over the table (partial aggregation on
the executors, one small row merged at the end) reshaped with ``unpivot`` into
one row per column. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.operators.quantiles import quantile_columns, quantile_table

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def table_shape(df: DataFrame, table: str) -> DataFrame:
    """One row: table name, number of rows, number of columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))


def _per_column(df: DataFrame, aggs: dict, value_name: str) -> DataFrame:
    """Evaluate one aggregate per column in a single pass, then one row per column."""
    one = df.agg(*[a.alias(c) for c, a in aggs.items()])
    return one.unpivot([], list(aggs), "column", value_name)


def _position(df: DataFrame):
    return F.element_at(F.create_map(*[x for i, c in enumerate(df.columns)
                                       for x in (F.lit(c), F.lit(i))]), F.col("column"))


def table_info(df: DataFrame, table: str) -> DataFrame:
    """Per column: position, non-null count and Spark type name."""
    info = _per_column(df, {c: F.count(c) for c in df.columns}, "non_null")
    dtypes = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return info.select(F.lit(table).alias("table"), _position(df).alias("position"), "column",
                       "non_null", F.element_at(dtypes, F.col("column")).alias("dtype"))


def table_head(df: DataFrame, order_by: str = "id", n: int = 5) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (top-k, not a full sort)."""
    return df.orderBy(order_by).limit(n)


def null_counts(df: DataFrame, table: str) -> DataFrame:
    """Per column: number of null values."""
    counts = _per_column(df, {c: F.count_if(F.col(c).isNull()) for c in df.columns}, "null_count")
    return counts.select(F.lit(table).alias("table"), _position(df).alias("position"), "column",
                         "null_count")


def duplicate_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows equal (null = null) to an earlier row, over all columns.

    Copies of a row collapse in the map-side partial aggregation, so a value
    repeated millions of times reaches the final aggregation once per task.
    """
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates")
                      ).select(F.lit(table).alias("table"), "duplicates")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """pandas ``describe()`` per numeric column, one row per column.

    count, mean, std (sample), min, 25%, 50%, 75% (linear interpolation), max;
    NaN is skipped like a missing value. All from the two passes of the exact
    quantiles over all columns (``quantile_table``).
    """
    columns = columns or numeric_columns(df)
    stats = quantile_table(df, columns, [0.25, 0.5, 0.75], moments=True)
    # a column without values has a row too
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(stats), "column", "left").select(
        "column", F.coalesce("n", F.lit(0)).alias("count"), "mean", "std", "min",
        *quantile_columns([0.25, 0.5, 0.75], ["p25", "p50", "p75"]), "max")
