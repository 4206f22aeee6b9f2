"""Exact quantiles, IQR fences and outlier selection.

Exact quantiles (``method="exact"``, the default) look up values by rank and never
order all values (``values_at_ranks``). One pass counts the rows of each bucket, a
range of values of about equal ratio, with its least and greatest value; the counts say
which buckets hold the wanted ranks, so a rank cannot fall beside them. A second pass
counts the rows of each distinct value in those buckets only (map-side partial
aggregation, so a value held by a third of the rows becomes one row per task). Cells
of equal width divide a bucket; running sums over the cells (a bounded number) say
which cells hold the ranks, and only the distinct values of those are ordered. Both
uses of the counts share one exchange, so the column is read twice. Everything is one
lazy plan: no checkpoint, and no job before the caller runs it. Interpolation is
numpy's linear method (what pandas ``quantile`` uses), bit for bit; Spark's
``percentile`` interpolates with a different formula that can differ in the last bit,
and merges all distinct values in one task. ``method="approx"`` uses
``percentile_approx`` alone (bounded memory, rank error about n/accuracy).

Fences are computed once per query as a scalar subquery and inlined into the
filter on the big table, so the table is streamed through a plain ``Filter``
(pushed into the Parquet scan where possible): no join, no shuffle of the rows
being tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.schemas import IQR_FACTOR

#: Buckets a factor of e, and the magnitude below which values share the buckets around 0.
STEPS, SMALL = 256, 1e-4
#: Cells per bucket.
CELLS = 4096
#: Buckets of infinities (and of what overflows), and of missing values.
_LAST, _NONE = 1 << 40, -(1 << 62)


def _prob_name(i: int) -> str:
    return f"_q{i}"


def _number(c) -> Column:
    """The column as double, NaN as missing."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v), v)


def bucket_sql(x: str = "x") -> str:
    """SQL of a bucket number that never falls when the value grows.

    Not null, also where the value is: an equality on it then adds no filter on the
    value, which would be pushed below the projection that computes it and evaluate
    that (possibly costly) expression once more.
    """
    size = f"least(floor(ln(1 + abs(cast({x} as double)) / {SMALL}D) * {STEPS}), {_LAST})"
    return f"coalesce(case when {x} < 0 then -{size} - 1 else {size} end, {_NONE})"


def cell_sql(x: str, least: str, most: str) -> str:
    """SQL of the cell of ``x`` among CELLS equal parts of [least, most]."""
    width = f"(cast({most} as double) - cast({least} as double))"
    return (f"case when {width} > 0 and {width} < cast('inf' as double) then "
            f"least({CELLS - 1}, cast(floor((cast({x} as double) - cast({least} as double)) / {width} * {CELLS}) as int)) else 0 end")


def _histogram(values: DataFrame, *extra: str) -> DataFrame:
    """(column, buckets): a row a column with the bucket, n, least, most (and extra aggregates) of its buckets.

    As one array a column (its length is bounded by the buckets), so that several
    readers prune nothing from the aggregate and share its exchange.
    """
    aggs = [F.expr(e) for e in ("count(x) as n", "min(x) as least", "max(x) as most", *extra)]
    per = values.groupBy("column", F.expr(bucket_sql()).alias("bucket")).agg(*aggs).filter("n > 0")
    return per.groupBy("column").agg(F.expr(f"collect_list(struct({', '.join(per.columns[1:])})) as buckets"))


def values_at_ranks(values: DataFrame, ranks: Callable[[DataFrame], DataFrame], count: int, *, by_column: bool = True,
                    histogram: DataFrame | None = None) -> DataFrame:
    """One row per column with a value: ``column``, ``total`` and, for each of ``count`` ranks, ``_v0, …`` and ``_below0, …``.

    ``values`` has ``column`` (not null) and ``x``, whose nulls are skipped. ``ranks``
    adds an array ``ranks`` of 0-based positions in ascending order of ``x`` to a
    DataFrame with ``column`` and ``total``, its number of values. ``_v`` is the value
    there, null without one; ``_below`` the number of smaller values. With
    ``by_column=False`` there is one column and one row, also without a value.
    """
    histogram = _histogram(values) if histogram is None else histogram
    per = histogram.select("column", F.inline("buckets")).selectExpr(
        "column", "bucket", "n", "least", "most", "sum(n) over (partition by column) as total",
        "sum(n) over (partition by column order by bucket) - n as off")
    holds = "exists(ranks, r -> r >= off and r < off + n)"
    # at most a row for each rank and column
    wanted = ranks(per).filter(holds).select("column", "bucket", "least", "most", "total", "off")
    cells = ["column", "bucket", "cell"]
    counts = (values.selectExpr("column", "x", f"{bucket_sql()} as bucket").join(F.broadcast(wanted), ["column", "bucket"])
              .groupBy("column", "bucket", F.expr(cell_sql("x", "least", "most")).alias("cell"), "total", "off", "x").agg(F.expr("count(1) as n")))
    # at most CELLS rows a bucket
    sizes = counts.groupBy(*cells, "total", "off").agg(F.expr("sum(n) as n")).selectExpr(
        *cells, "total", "n", "off + sum(n) over (partition by column, bucket order by cell) - n as off")
    few = ranks(sizes).filter(holds).selectExpr(*cells, "off as cell_off", "ranks")
    ordered = counts.join(F.broadcast(few), cells).selectExpr(
        "column", "x", "n", "total", "ranks", "cell_off + sum(n) over (partition by column, bucket, cell order by x "
        "rows between unbounded preceding and current row) as upto")
    aggs = ["max(total) as total"]
    for i in range(count):
        hit = f"case when ranks[{i}] >= upto - n and ranks[{i}] < upto then"
        aggs += [f"max({hit} x end) as _v{i}", f"max({hit} upto - n end) as _below{i}"]
    return (ordered.groupBy("column") if by_column else ordered).agg(*map(F.expr, aggs))


def column_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x): the numbers of each column, one row a value."""
    if len(columns) == 1:
        return df.select(F.lit(columns[0]).alias("column"), _number(columns[0]).alias("x"))
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _number(c).alias("x")) for c in columns])))


def _ranks(total: str, probs: list[float]) -> str:
    """SQL of the array of both ranks around each quantile."""
    return "array(" + ", ".join(r for p in probs for r in _positions(total, p)[:2]) + ")"


def quantile_table(df: DataFrame, columns: list[str], probs: list[float], *, moments: bool = False, by_column: bool = True) -> DataFrame:
    """One row per column that has a value: ``column``, ``n`` and ``_q0, _q1, …`` (one per prob).

    Nulls and NaN are skipped. Exact: the values at ranks floor((n - 1) p) and
    the next one, interpolated as numpy does. ``moments`` adds ``mean``, ``std``
    (sample), ``min`` and ``max`` from the same two passes. With ``by_column=False``
    there is one column and always one row, without a name.
    """
    values = column_values(df, columns)
    finite = "case when abs(x) < cast('inf' as double) then x end"
    histogram = _histogram(values, f"count({finite}) as finite", f"avg({finite}) as avg", f"var_pop({finite}) as var") if moments else None
    picked = values_at_ranks(values, lambda d: d.withColumn("ranks", F.expr(_ranks("total", probs))), 2 * len(probs),
                             by_column=by_column, histogram=histogram)
    quantiles = picked.selectExpr(*["column"] * by_column, "total as n", *[
        f"{_lerp(f'_v{2 * i}', f'_v{2 * i + 1}', _positions('total', p)[2])} as {_prob_name(i)}" for i, p in enumerate(probs)])
    # a row a column on both sides
    return quantiles.join(F.broadcast(_moments(histogram)), "column") if moments else quantiles


def _moments(histogram: DataFrame) -> DataFrame:
    """(column, mean, std, min, max) from the buckets' moments; infinities propagate as floats do."""
    per = histogram.select("column", F.inline("buckets")).selectExpr(
        "*", "sum(avg * finite) over (partition by column) / nullif(sum(finite) over (partition by column), 0) as centre")
    one = per.groupBy("column").agg(*map(F.expr, (
        "max(centre) as centre", "sum(n) as n", "sum(var * finite + (avg - centre) * (avg - centre) * finite) as squares", "min(least) as min", "max(most) as max")))
    inf, nan = "cast('inf' as double)", "cast('nan' as double)"
    return one.selectExpr(
        "column", f"case when min = -{inf} and max = {inf} then {nan} when min = -{inf} then min when max = {inf} then max else centre end as mean",
        f"case when n > 1 then case when min = -{inf} or max = {inf} then {nan} else sqrt(squares / (n - 1)) end end as std", "min", "max")


def _positions(n: str, p: float) -> tuple[str, str, str]:
    """SQL of the 0-based ranks around (n - 1) * p and the fraction between them (numpy 'linear')."""
    pos = f"(({n} - 1) * {float(p)!r}D)"
    prev = f"floor({pos})"
    return prev, f"least({prev} + 1, {n} - 1)", f"({pos} - {prev})"


def _lerp(a: str, b: str, t: str) -> str:
    """SQL of numpy's interpolation: a + (b - a) t, or b - (b - a)(1 - t) when t >= 0.5."""
    return f"case when {t} >= 0.5D then {b} - ({b} - {a}) * (1.0D - {t}) else {a} + ({b} - {a}) * {t} end"


def _quartile_row(df: DataFrame, column: str, method: str, accuracy: int) -> DataFrame:
    """One row with q1, q3 (null when the column has no value)."""
    if method == "exact":
        return quantile_table(df, [column], [0.25, 0.75], by_column=False).select(F.col("_q0").alias("q1"), F.col("_q1").alias("q3"))
    if method != "approx":
        raise ValueError(f"unknown method {method!r}")
    q = F.percentile_approx(column, F.array(F.lit(0.25), F.lit(0.75)), accuracy)
    return df.agg(q.alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


def quartiles(df: DataFrame, column: str, method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """One row: q1, q3 of ``column`` (nulls skipped, linear interpolation)."""
    return _quartile_row(df, column, method, accuracy)


def iqr_bounds(df: DataFrame, column: str, factor: float = IQR_FACTOR, method: str = "exact",
               accuracy: int = 10000) -> DataFrame:
    """One row: column, q1, q3, iqr, lb, ub with lb = q1 - factor*iqr, ub = q3 + factor*iqr."""
    q = quartiles(df, column, method, accuracy)
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        F.lit(column).alias("column"), "q1", "q3", iqr.alias("iqr"),
        (F.col("q1") - F.lit(factor) * iqr).alias("lb"),
        (F.col("q3") + F.lit(factor) * iqr).alias("ub"),
    )


def outliers(df: DataFrame, column: str, side: str, factor: float = IQR_FACTOR,
             method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """Rows of ``df`` strictly below the lower (``side='low'``) or above the upper fence."""
    bounds = iqr_bounds(df, column, factor, method, accuracy)
    if side == "low":
        return df.filter(F.col(column) < bounds.select("lb").scalar())
    if side == "high":
        # NaN is above every number here, but beyond no fence
        return df.filter((F.col(column) > bounds.select("ub").scalar()) & ~F.isnan(F.col(column).cast("double")))
    raise ValueError(f"side must be 'low' or 'high', not {side!r}")


def outlier_shape(df: DataFrame, column: str, side: str, factor: float = IQR_FACTOR) -> DataFrame:
    """One row: rows and columns of ``outliers(df, column, side)``."""
    return shape(outliers(df, column, side, factor))


def shape(df: DataFrame) -> DataFrame:
    """One row: rows and columns of ``df`` (pandas ``.shape``)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))


def quantile_columns(probs, names) -> list[Column]:
    """Rename ``_q0, _q1, …`` of ``quantile_table`` to ``names``."""
    return [F.col(_prob_name(i)).alias(n) for i, n in enumerate(names)]
