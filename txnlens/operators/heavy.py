"""Top-k reports by key without a shuffle of every key.

A grouped top-k sends each task's partial row of every key through the shuffle. Where
few keys are heavy, a bounded summary says which ones can be among the first:

1. The rows are counted into ``buckets`` hash buckets of keys. A bucket's sum of
   positive measures is at least the total of each of its keys (``bounds``).
2. The keys of the ``pilots`` buckets with the largest bounds are totalled exactly; the
   n-th largest total among them is a total that the n-th key of all has at least.
3. The keys of every bucket whose bound reaches it are totalled exactly and ordered.

No key of step 3 is an estimate, and no key outside can reach the first n, so the
rows are those of the plain report, ties included. The bounds decide how many keys
step 3 keeps: where they do not part the first n from the rest (keys of like weight),
it keeps all of them and is the plain report.

All three read the pruned table; the shuffles hold at most ``buckets`` rows a task and
the keys that remain. The bucket tables are broadcast: at most ``buckets`` numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions.numeric import money_avg, money_state, money_sum, money_value

#: Hash buckets of the summary, and those whose keys are totalled first.
BUCKETS, PILOTS = 1 << 16, 64

_BUCKET = "__bucket"


def _bucket(key: str, buckets: int) -> Column:
    # never null, also for the planner: a pushed null check would part the two uses of the bounds, which share an exchange
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)), F.lit(0).cast("long")).alias(_BUCKET)


def _upper(bound: Column) -> Column:
    """Room for the rounding of values that are summed as doubles."""
    return bound + F.abs(bound) * F.lit(1e-6)


def bounds(df: DataFrame, key: str, value: str | None, buckets: int = BUCKETS) -> DataFrame:
    """(__bucket, bound): at least the total (``value`` null: the non-null count) of each key of a hash bucket."""
    positive = F.when(F.col(value) > 0, F.col(value)) if value else None
    bound = _upper(F.coalesce(money_value(money_state(positive)), F.lit(0.0))) if value else F.count("__counted").cast("double")
    return df.groupBy(_bucket(key, buckets)).agg(bound.alias("bound"))


def heavy_keys(df: DataFrame, key: str, measures: list[Column], order: str, n: int, *, value: str | None, counted: str | None = None,
               buckets: int = BUCKETS, pilots: int = PILOTS) -> DataFrame:
    """The ``n`` keys with the largest ``order``, one of ``measures`` (aggregates with names), ties by key.

    ``order`` is the total of ``value`` (``money_sum``), or with ``value=None`` the
    number of rows in which ``counted`` is not null. Null keys are dropped.
    """
    if (value is None) == (counted is None):
        raise ValueError("order by the total of a value or by a count, one of them")
    if buckets < 1 or pilots < 1 or n < 1:
        raise ValueError("buckets, pilots and n are at least 1")
    keyed = df.filter(F.col(key).isNotNull())
    sums = bounds(keyed if value else keyed.withColumn("__counted", F.col(counted)), key, value, buckets)

    def totals(of: DataFrame) -> DataFrame:
        # at most `buckets` rows of one number
        rows = keyed.withColumn(_BUCKET, _bucket(key, buckets)).join(F.broadcast(of.select(_BUCKET)), _BUCKET, "left_semi")
        return rows.groupBy(key).agg(*measures)

    first = totals(sums.orderBy(F.desc("bound"), _BUCKET).limit(pilots))
    least = first.orderBy(F.desc(order)).limit(n).agg(F.when(F.count(F.lit(1)) == n, F.min(order).cast("double")).alias("least")).scalar()
    reaching = sums.filter(F.col("bound") >= F.coalesce(least, F.lit(float("-inf"))))
    return totals(reaching).orderBy(F.desc(order), F.asc(key)).limit(n)


def _summary() -> list[Column]:
    return [money_sum("amount").alias("total_spent"), money_avg("amount").alias("avg_transaction"), F.count("amount").alias("transaction_count")]


def heavy_spenders(txn: DataFrame, n: int = 5, **bounded) -> DataFrame:
    """``top_spenders`` without a shuffle of all customers."""
    return heavy_keys(txn, "client_id", _summary(), "total_spent", n, value="amount", **bounded)


def heavy_customers(txn: DataFrame, n: int = 5, **bounded) -> DataFrame:
    """``most_active_customers`` without a shuffle of all customers."""
    return heavy_keys(txn, "client_id", _summary(), "transaction_count", n, value=None, counted="amount", **bounded)


def heavy_places(txn: DataFrame, key: str, n: int = 10, **bounded) -> DataFrame:
    """``top_places`` (state or city) without a shuffle of all places."""
    return heavy_keys(txn, key, [F.count("amount").alias("count"), money_sum("amount").alias("total")], "total", n, value="amount", **bounded)
