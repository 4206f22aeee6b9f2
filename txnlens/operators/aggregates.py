"""Grouped reports: per channel, year, hour, place, customer, error type, user group.

All follow pandas ``groupby`` semantics: rows with a null key are dropped,
``count`` counts non-null amounts, a group's sum of no values is 0 and its mean
is null. Sorts break ties by the key so results are deterministic. Each report
is one hash aggregation with map-side partial aggregation, so a key holding a
large share of the rows (ONLINE, a heavy customer) is reduced before the
shuffle; top-k reports plan as ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.numeric import float_mean, money_avg, money_sum
from txnlens.schemas import NO_ERRORS


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def amount_by(df: DataFrame, key: str, count_name: str = "count", sum_name: str | None = "total",
              avg_name: str | None = None, value: str = "amount") -> DataFrame:
    """count / sum / mean of ``value`` per ``key`` (null keys dropped)."""
    aggs = [F.count(value).alias(count_name)]
    if sum_name:
        aggs.append(money_sum(value).alias(sum_name))
    if avg_name:
        aggs.append(money_avg(value).alias(avg_name))
    return _keyed(df, key).groupBy(key).agg(*aggs)


def txn_by_channel(txn: DataFrame) -> DataFrame:
    """Per ``use_chip``: transaction_count, avg_amount, total_volume; total desc."""
    r = amount_by(txn, "use_chip", "transaction_count", "total_volume", "avg_amount")
    return r.select("use_chip", "transaction_count", "avg_amount", "total_volume").orderBy(
        F.desc("total_volume"), F.asc("use_chip"))


def txn_by_year(txn: DataFrame) -> DataFrame:
    """Per ``year``: count, total, avg; year ascending."""
    return amount_by(txn, "year", "count", "total", "avg").orderBy("year")


def busiest_hours(txn: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` hours with most (non-null) amounts."""
    return amount_by(txn, "hour", "count", None).orderBy(F.desc("count"), F.asc("hour")).limit(n)


def top_places(txn: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` places (state or city) with the largest total amount."""
    return amount_by(txn, key, "count", "total").orderBy(F.desc("total"), F.asc(key)).limit(n)


def top_states(txn: DataFrame, n: int = 10) -> DataFrame:
    """States after filling, so ONLINE competes with the real states."""
    return top_places(txn, "merchant_state", n)


def top_cities(txn: DataFrame, n: int = 10) -> DataFrame:
    return top_places(txn, "merchant_city", n)


def customer_summary(txn: DataFrame) -> DataFrame:
    """Per ``client_id``: total_spent, avg_transaction, transaction_count."""
    return amount_by(txn, "client_id", "transaction_count", "total_spent", "avg_transaction").select(
        "client_id", "total_spent", "avg_transaction", "transaction_count")


def top_spenders(txn: DataFrame, n: int = 5) -> DataFrame:
    return customer_summary(txn).orderBy(F.desc("total_spent"), F.asc("client_id")).limit(n)


def most_active_customers(txn: DataFrame, n: int = 5) -> DataFrame:
    return customer_summary(txn).orderBy(F.desc("transaction_count"), F.asc("client_id")).limit(n)


def error_types(txn: DataFrame) -> DataFrame:
    """Per error type of failed transactions: count and avg_amount; count desc."""
    failed = txn.filter(F.col("errors") != NO_ERRORS)
    return amount_by(failed, "errors", "count", None, "avg_amount").orderBy(
        F.desc("count"), F.asc("errors"))


def value_counts(df: DataFrame, column: str, count_name: str = "count") -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    return (_keyed(df, column).groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
            .orderBy(F.desc(count_name), F.asc(column)))


def value_shares(df: DataFrame, column: str, share_name: str = "proportion") -> DataFrame:
    """Share of each non-null value among the non-null values.

    The total is a scalar subquery over the per-value counts themselves, so it
    reuses their shuffle instead of scanning the input again, and the counts
    are never gathered into a single partition.
    """
    counts = value_counts(df, column)
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(column, (F.col("count") / total).alias(share_name)).orderBy(
        F.desc(share_name), F.asc(column))


def group_means(df: DataFrame, key: str, columns) -> DataFrame:
    """pandas ``groupby(key)[columns].mean()``; key ascending."""
    aggs = [float_mean(c).alias(c) for c in columns]
    return _keyed(df, key).groupBy(key).agg(*aggs).orderBy(key)


def gender_counts(users: DataFrame) -> DataFrame:
    return value_counts(users, "gender")


def gender_means(users: DataFrame) -> DataFrame:
    return group_means(users, "gender",
                       ["per_capita_income", "yearly_income", "total_debt", "debt_to_income"])


def retired_means(users: DataFrame) -> DataFrame:
    return group_means(users, "is_retired", ["yearly_income", "total_debt", "credit_score"])


def label_counts(labels: DataFrame) -> DataFrame:
    return value_counts(labels, "Target")


def label_shares(labels: DataFrame) -> DataFrame:
    return value_shares(labels, "Target")
