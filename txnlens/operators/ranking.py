"""Global row numbers and tiles without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task.

Tiles (``tiles_by_rank``) need no row numbers: the rows at the tiles' last ranks are
looked up by counts, and each row is compared with these few. All
lazy, nothing is written. For row numbers (``global_row_number``)
the rows are range-partitioned on the sort key and sorted inside each
partition; each row gets its partition number and local position from
``monotonically_increasing_id``; the table is checkpointed to the shared
checkpoint folder so those ids are fixed (a recomputation after a lost
executor cannot renumber them); per-partition row counts (one row per
partition) give each partition's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.quantiles import bucket_sql, cell_sql
from txnlens.session import reliable_checkpoint

_PART_BITS = 33  # monotonically_increasing_id keeps the partition id above bit 33


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number",
                      partitions: int | None = None, total_name: str | None = None) -> DataFrame:
    """Add ``name``: 1-based position of each row in ``order`` (must be a total order).

    ``total_name`` also adds the total row count, taken from the same
    per-partition table.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_rid", F.monotonically_increasing_id()))
    ranged = reliable_checkpoint(ranged)

    part = F.shiftright(F.col("_rid"), _PART_BITS)
    local = F.col("_rid") - F.shiftleft(part, _PART_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                           F.sum("_n").over(Window.partitionBy()).alias("_total"))
    numbered = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbered = numbered.withColumn(name, F.col("_offset") + local + 1)
    if total_name:
        numbered = numbered.withColumnRenamed("_total", total_name)
    return numbered.drop("_part", "_offset", "_rid", "_total")


def ntile(df: DataFrame, order: list[Column], tiles: int, name: str = "ntile",
          partitions: int | None = None) -> DataFrame:
    """SQL ``ntile(tiles) OVER (ORDER BY order)`` computed with ``global_row_number``.

    With n rows, q = n div tiles and r = n mod tiles: the first r tiles hold
    q + 1 rows, the others q.
    """
    numbered = global_row_number(df, order, "_rn", partitions, total_name="_n")
    total = F.col("_n")
    q = F.floor(total / F.lit(tiles))
    r = total - q * F.lit(tiles)
    rn = F.col("_rn")
    big = r * (q + 1)
    tile = (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
            .otherwise(r + F.floor((rn - 1 - big) / q) + 1))
    return numbered.withColumn(name, tile.cast("int")).drop("_rn", "_n")


def tiles_by_rank(df: DataFrame, value: str, key: str, tiles: int, name: str = "ntile") -> DataFrame:
    """SQL ``ntile(tiles) OVER (ORDER BY value DESC, key)`` by the tiles' last rows.

    ``value`` is a number (NaN counts as the largest), ``key`` an integer that breaks
    ties; (value, key) must be unique and not null. Four passes of counts narrow the
    rows at the tiles' last ranks down: buckets of values, cells of the buckets, each
    cell's values by ranges of keys (so a value that a third of the rows share is no
    hot group), and the keys of these ranges. A pass takes up the last one's few rows
    by broadcast, at most one a tile. The rows found reach the table as a scalar. The
    plan reads ``df`` five times: it should be an aggregate, whose exchange is shared.
    """
    rows = df.selectExpr(f"{key} as k", f"-nanvl(cast({value} as double), cast('inf' as double)) as x")
    ends = "array(" + ", ".join(f"total div {tiles} * {t} + least({t}, total % {tiles}) - 1" for t in range(1, tiles)) + ")"
    holds = f"exists({ends if tiles > 1 else 'array(-1L)'}, r -> r >= off and r < off + n)"
    bucket, counts = bucket_sql("x"), "count(1) as n"

    def group(found: DataFrame, keys: str, *aggs: str) -> DataFrame:
        return found.groupBy(*map(F.expr, keys.split(", "))).agg(*map(F.expr, (counts, *aggs)))

    # a row a bucket, whose number is bounded
    per = group(rows.selectExpr("x", f"{bucket} as bucket"), "bucket", "min(x) as low", "max(x) as high")
    wanted = per.selectExpr("*", "sum(n) over () as total", "sum(n) over (order by bucket) - n as off").filter(holds).drop("n")
    found = rows.selectExpr("*", f"{bucket} as bucket").join(F.broadcast(wanted), "bucket").withColumn("cell", F.expr(cell_sql("x", "low", "high")))
    per = group(found, "bucket, low, high, total, off, cell", "min(k) as first", "max(k) as last")
    wanted = per.withColumn("off", F.expr("off + sum(n) over (partition by bucket order by cell) - n")).filter(holds).drop("n")
    found = rows.selectExpr("*", f"{bucket} as bucket").join(F.broadcast(wanted.withColumnRenamed("cell", "at")), "bucket").filter(
        f"{cell_sql('x', 'low', 'high')} = at").withColumn("range", F.expr(cell_sql("k", "first", "last")))
    per = group(found, "bucket, at, x, first, last, total, off, range")
    wanted = per.withColumn("off", F.expr("off + sum(n) over (partition by bucket, at order by x, range) - n")).filter(holds)
    found = rows.join(F.broadcast(wanted.select("x", "first", "last", "total", "off", "range")), "x").filter(f"{cell_sql('k', 'first', 'last')} = range")
    placed = found.withColumn("at", F.expr("off + row_number() over (partition by x, range order by k) - 1"))
    bounds = placed.selectExpr("x", "k", f"explode(filter({ends if tiles > 1 else 'array(-1L)'}, r -> r = at)) as r").agg(
        F.collect_list(F.struct("x", "k")).alias("b"))
    x = f"-nanvl(cast({value} as double), cast('inf' as double))"
    after = f"size(filter(_bounds, b -> {x} > b.x or {x} = b.x and {key} > b.k)) + 1"
    return df.withColumn("_bounds", bounds.scalar()).withColumn(name, F.expr(after)).drop("_bounds")
