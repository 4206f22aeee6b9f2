"""Fraud and risk reports over cleaned transactions with features.

The analysis areas are described in prose only (no formula, threshold or
column name), so the definitions here are ours; thresholds are arguments with
the documented defaults. ``transactions`` counts rows; rates are
``errors / transactions``; an error is any ``errors`` value other than
``No Errors``.

Scale notes: every join here is between tables with at most one row per key on
each side, because the transactions are first reduced per key (card, client,
category) with map-side partial aggregation. Windows only run over results
already reduced to a calendar- or domain-sized key (years, channels, states);
global ratios use scalar subqueries evaluated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.numeric import flag, merge_money, money_avg, money_state, money_sum, money_value, rate
from txnlens.operators.binning import band_label
from txnlens.operators.ranking import tiles_by_rank
from txnlens.schemas import CREDIT_EDGES, CREDIT_LABELS, DARK_WEB_YES, FRAUD_YES, NO_ERRORS, TIER_NAMES

#: Stands for a user without an id in a null-safe join: no client has it.
_NO_USER = -(1 << 63)

CHANNELS = ("Chip Transaction", "Online Transaction", "Swipe Transaction")


def is_error():
    return flag(F.col("errors") != NO_ERRORS)


def _error_stats():
    return [F.count(F.lit(1)).alias("transactions"), F.sum(is_error()).alias("errors")]


def _with_rate(df: DataFrame, num: str = "errors", den: str = "transactions", name: str = "error_rate"):
    return df.withColumn(name, rate(num, den))


def overall_rate(per_key: DataFrame, num: str = "errors", den: str = "transactions"):
    """Scalar subquery: sum(num) / sum(den) over a per-key aggregate.

    The subquery has the aggregate's own plan, so its shuffle is reused as long as
    no filter is pushed below the aggregate beside it; see ``_of_known``.
    """
    return per_key.agg(rate(F.sum(num), F.sum(den))).scalar()


def _of_known(per_key: DataFrame, key: str, column: str):
    """``column`` where the key is not null, as a condition that can't be pushed below the aggregate.

    A plain ``key is not null`` would be, and the aggregate would then differ from the
    one of ``overall_rate`` and be computed from a second scan.
    """
    return F.get(F.array(F.col(column)), F.when(F.col(key).isNull(), 1).otherwise(0))


# D-1 ------------------------------------------------------------------------
def overview(txn: DataFrame, approx: bool = False) -> DataFrame:
    """Size, date range and distinct customers, cards and merchants."""
    distinct = F.approx_count_distinct if approx else F.countDistinct
    return txn.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        distinct("client_id").alias("customers"),
        distinct("card_id").alias("cards"),
        distinct("merchant_id").alias("merchants"),
    )


# D-2 ------------------------------------------------------------------------
def revenue_growth(txn: DataFrame, approx: bool = False) -> DataFrame:
    """Per year: transactions, revenue, average amount, customers, growth in %.

    ``approx=True`` counts customers with HyperLogLog (one aggregation, no
    distinct-key shuffle) instead of exactly.
    """
    distinct = F.approx_count_distinct if approx else F.countDistinct
    per_year = txn.filter(F.col("year").isNotNull()).groupBy("year").agg(
        F.count(F.lit(1)).alias("transactions"),
        money_sum("amount").alias("revenue"),
        money_avg("amount").alias("avg_amount"),
        distinct("client_id").alias("customers"),
    )
    return with_growth(per_year)


def with_growth(per_year: DataFrame) -> DataFrame:
    """Adds ``growth_pct`` of the revenue against the year before; one row per calendar year."""
    prev = F.lag("revenue").over(Window.orderBy("year"))
    return per_year.withColumn(
        "growth_pct", F.try_divide(F.lit(100) * (F.col("revenue") - prev), prev)).orderBy("year")


# D-3 ------------------------------------------------------------------------
def error_rate_by_type(txn: DataFrame) -> DataFrame:
    """Per error type: count, share of all errors, share of all transactions."""
    per_kind = txn.groupBy("errors").agg(F.count(F.lit(1)).alias("count"))
    # totals over one row per error type, before the filter, so the transactions are read once
    everything = Window.partitionBy()
    failed = F.col("errors") != NO_ERRORS
    return (per_kind
            .withColumn("share_of_errors", rate(F.col("count"), F.sum(F.when(failed, F.col("count"))).over(everything)))
            .withColumn("share_of_transactions", rate(F.col("count"), F.sum("count").over(everything)))
            .filter(failed).orderBy(F.desc("count"), "errors"))


def high_risk_customers(txn: DataFrame, min_transactions: int = 50, n: int | None = None) -> DataFrame:
    """Customers with at least ``min_transactions``, highest error rate first; the first ``n`` or all.

    Transactions without a customer are nobody's.
    """
    per_client = txn.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(*_error_stats())
    ranked = _with_rate(per_client.filter(F.col("transactions") >= min_transactions)).orderBy(F.desc("error_rate"), "client_id")
    return ranked if n is None else ranked.limit(n)


def high_value_errors(txn: DataFrame) -> DataFrame:
    """Error rate of high-value vs other transactions."""
    return _with_rate(txn.groupBy("is_high_value").agg(*_error_stats())).orderBy("is_high_value")


# D-4 ------------------------------------------------------------------------
def _per_card(txn: DataFrame) -> DataFrame:
    return txn.groupBy("card_id").agg(
        *_error_stats(),
        money_state("amount").alias("_amount"),
        F.count("amount").alias("_amount_n"),
    )


def dark_web_cards(txn: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards listed on the dark web vs the rest: cards used, transactions, errors, rate, avg amount.

    Transactions are reduced to one row per card before the join, so the join
    is one-to-one whatever the skew of cards.
    """
    per_card = _per_card(txn)
    flags = cards.select(F.col("id").alias("card_id"), "card_on_dark_web")
    j = per_card.join(flags, "card_id")
    out = j.groupBy("card_on_dark_web").agg(
        F.count(F.lit(1)).alias("cards"),
        F.sum("transactions").alias("transactions"),
        F.sum("errors").alias("errors"),
        (money_value(merge_money("_amount")) / F.nullif(F.sum("_amount_n"), F.lit(0))).alias("avg_amount"),
    )
    return _with_rate(out).orderBy("card_on_dark_web")


def unmatched_card_transactions(txn: DataFrame, cards: DataFrame) -> DataFrame:
    """Transactions whose card is missing from the cards table (left anti join).

    A transaction without a card number counts as a transaction, not as a card.
    """
    per_card = txn.groupBy("card_id").agg(F.count(F.lit(1)).alias("transactions"))
    missing = per_card.join(cards.select(F.col("id").alias("card_id")), "card_id", "left_anti")
    return missing.agg(F.count("card_id").alias("cards"),
                       F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"))


# D-5 ------------------------------------------------------------------------
def channel_mix_by_year(txn: DataFrame) -> DataFrame:
    """Per year and channel: transactions and share of the year's transactions."""
    counts = (txn.filter(F.col("year").isNotNull() & F.col("use_chip").isNotNull())
              .groupBy("year", "use_chip").agg(F.count(F.lit(1)).alias("transactions")))
    # a year holds one row per channel
    year_total = F.sum("transactions").over(Window.partitionBy("year"))
    return counts.withColumn("share", rate(F.col("transactions"), year_total)).orderBy("year", "use_chip")


def channel_mix_wide(txn: DataFrame, channels=CHANNELS, names=None) -> DataFrame:
    """One row per year, one transaction-count column per listed channel, and ``other``.

    ``other`` holds every other channel and transactions without one, so a row adds
    up to its year. ``names`` are the column names (default: the channels' first
    words, lower case; they must differ).
    """
    names = list(names or [c.split()[0].lower() for c in channels])
    if len({*names, "other", "year"}) != len(channels) + 2:
        raise ValueError(f"column names {names} are not distinct")
    listed = F.coalesce(F.col("use_chip").isin(*channels), F.lit(False))
    return txn.filter(F.col("year").isNotNull()).groupBy("year").agg(
        *[F.count_if(F.col("use_chip") == c).alias(n) for c, n in zip(channels, names, strict=True)],
        F.count_if(~listed).alias("other")).orderBy("year")


# D-6 ------------------------------------------------------------------------
def customer_tiers(txn: DataFrame, tiers=TIER_NAMES) -> DataFrame:
    """Customers by total spend in equal-count tiers (``ntile``), best tier first."""
    spend = txn.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(money_sum("amount").alias("total_spent"))
    ranked = tiles_by_rank(spend, "total_spent", "client_id", len(tiers), "tier_rank")
    names = F.array(*[F.lit(t) for t in tiers])
    return ranked.withColumn("tier", F.element_at(names, F.col("tier_rank"))).select(
        "client_id", "total_spent", "tier_rank", "tier")


def tier_summary(tiers: DataFrame) -> DataFrame:
    """Per tier: customers, total and mean spend."""
    return tiers.groupBy("tier_rank", "tier").agg(
        F.count(F.lit(1)).alias("customers"),
        money_sum("total_spent").alias("total_spent"),
        money_avg("total_spent").alias("avg_spent"),
    ).orderBy("tier_rank")


# D-7 ------------------------------------------------------------------------
def geography(txn: DataFrame, approx: bool = False) -> DataFrame:
    """Per state (ONLINE included): volume, revenue, merchants, share and rank.

    ``approx=True`` counts merchants with HyperLogLog instead of exactly.
    """
    distinct = F.approx_count_distinct if approx else F.countDistinct
    per_state = txn.filter(F.col("merchant_state").isNotNull()).groupBy("merchant_state").agg(
        F.count(F.lit(1)).alias("transactions"),
        money_sum("amount").alias("revenue"),
        distinct("merchant_id").alias("merchants"),
    )
    return with_volume_rank(per_state)


def with_volume_rank(per_state: DataFrame) -> DataFrame:
    """Adds transactions per merchant, share and rank by volume; windows over one row per state."""
    n_txn = F.sum("transactions").over(Window.partitionBy())
    by_volume = Window.orderBy(F.desc("transactions"))
    return (per_state
            .withColumn("txn_per_merchant", rate("transactions", "merchants"))
            .withColumn("share", rate(F.col("transactions"), n_txn))
            .withColumn("rank", F.rank().over(by_volume))
            .orderBy("rank", "merchant_state"))


# D-8 ------------------------------------------------------------------------
def merchant_categories(txn: DataFrame, mcc: DataFrame, min_transactions: int = 0) -> DataFrame:
    """Per merchant category code: description, transactions, errors, error rate.

    ``min_transactions`` leaves out rarer codes (default: none is). Codes missing
    from the lookup are described as ``Unknown``. Transactions
    are reduced to one row per code before the join; both sides are then small
    (one row per code), and the planner's size check picks the join.
    """
    per_code = txn.groupBy("mcc").agg(*_error_stats()).filter(F.col("transactions") >= min_transactions)
    lookup = mcc.select(F.col("code").alias("mcc"), "description")
    return (_with_rate(per_code.join(lookup, "mcc", "left"))
            .withColumn("description", F.coalesce(F.col("description"), F.lit("Unknown")))
            .select("mcc", "description", "transactions", "errors", "error_rate")
            .orderBy(F.desc("error_rate"), "mcc"))


# D-9 ------------------------------------------------------------------------
def refund_summary(txn: DataFrame) -> DataFrame:
    """Refund count, rate, refunded and net amount per year plus a total row."""
    refunded = F.when(F.col("is_refund") == 1, F.col("amount"))
    out = txn.rollup("year").agg(
        F.grouping("year").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("transactions"),
        F.sum("is_refund").alias("refunds"),
        money_sum(refunded).alias("refunded_amount"),
        money_sum("amount").alias("net_amount"),
    )
    return _with_rate(out, "refunds", "transactions", "refund_rate").orderBy("is_total", "year")


def refund_customers(txn: DataFrame, min_refunds: int = 5, factor: float = 2.0) -> DataFrame:
    """Customers with at least ``min_refunds`` refunds and a refund rate above
    ``factor`` times the rate of all transactions, those without a customer included."""
    per_client = txn.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("is_refund").alias("refunds"))
    overall = overall_rate(per_client, "refunds")
    return (_with_rate(per_client, "refunds", "transactions", "refund_rate")
            .filter((_of_known(per_client, "client_id", "refunds") >= min_refunds) & (F.col("refund_rate") > F.lit(factor) * overall))
            .orderBy(F.desc("refund_rate"), "client_id"))


# D-10 -----------------------------------------------------------------------
def _night(night_start: int, night_end: int):
    return flag((F.col("hour") >= night_start) & (F.col("hour") < night_end))


def error_rate_by_hour(txn: DataFrame, night_start: int = 2, night_end: int = 6) -> DataFrame:
    """Per hour of day: transactions, errors, rate, and whether the hour is at night."""
    per_hour = txn.filter(F.col("hour").isNotNull()).groupBy("hour").agg(*_error_stats())
    return _with_rate(per_hour).withColumn("night", _night(night_start, night_end)).orderBy("hour")


def error_rate_night(txn: DataFrame, night_start: int = 2, night_end: int = 6) -> DataFrame:
    """Night hours vs the rest of the day."""
    return _with_rate(txn.filter(F.col("hour").isNotNull())
                      .groupBy(_night(night_start, night_end).alias("night")).agg(*_error_stats())
                      ).orderBy("night")


# D-11 -----------------------------------------------------------------------
def chip_vs_swipe_errors(txn: DataFrame) -> DataFrame:
    """Per payment channel: transactions, errors, error rate."""
    return _with_rate(txn.filter(F.col("use_chip").isNotNull()).groupBy("use_chip").agg(*_error_stats())
                      ).orderBy("use_chip")


def dark_web_by_card_type(cards: DataFrame) -> DataFrame:
    """Per card type and chip flag: cards, cards on the dark web, their share."""
    out = cards.groupBy("card_type", "is_chip_enabled").agg(
        F.count(F.lit(1)).alias("cards"),
        F.sum(flag(F.col("card_on_dark_web") == DARK_WEB_YES)).alias("dark_web_cards"),
    )
    return _with_rate(out, "dark_web_cards", "cards", "dark_web_rate").orderBy("card_type", "is_chip_enabled")


# D-12 -----------------------------------------------------------------------
def customer_risk(users: DataFrame, txn: DataFrame, cards: DataFrame,
                  rate_factor: float = 1.5) -> DataFrame:
    """Risk score per customer from credit band, error rate and compromised cards.

    Points: a credit score up to the Poor band's upper edge 3 (scores below the
    band too), Fair 2, Good 1, otherwise 0, also when it is unknown (the band then
    reads ``Unknown``); error rate above
    ``rate_factor`` x overall 2, above overall 1; any card on the dark web 2.
    Band: score >= 5 High, >= 3 Medium, else Low. All three inputs are one row
    per customer when joined.
    """
    per_client = txn.groupBy("client_id").agg(*_error_stats())
    compromised = cards.groupBy("client_id").agg(
        F.max(flag(F.col("card_on_dark_web") == DARK_WEB_YES)).alias("compromised"))
    overall = overall_rate(per_client)
    base = users.select(F.col("id").alias("client_id"), "credit_score")
    # null-safe, so that no filter on the key is pushed below the aggregate; no user has the null key's row
    known = per_client.select(F.col("client_id").alias("_client"), "transactions", "errors")
    j = base.join(known, F.coalesce("client_id", F.lit(_NO_USER)).eqNullSafe(F.col("_client")), "left").join(compromised, "client_id", "left")
    band = (F.when(F.col("credit_score").isNull(), "Unknown").when(F.col("credit_score") <= CREDIT_EDGES[1], CREDIT_LABELS[0])
            .otherwise(F.coalesce(band_label("credit_score"), F.lit("Unknown"))))
    err = rate("errors", "transactions")
    credit_pts = F.when(band == "Poor", 3).when(band == "Fair", 2).when(band == "Good", 1).otherwise(0)
    rate_pts = F.when(err > F.lit(rate_factor) * overall, 2).when(err > overall, 1).otherwise(0)
    comp = F.coalesce(F.col("compromised"), F.lit(0))
    score = credit_pts + rate_pts + F.when(comp == 1, 2).otherwise(0)
    out = j.select(
        "client_id", "credit_score", band.alias("credit_band"),
        F.coalesce(F.col("transactions"), F.lit(0)).alias("transactions"),
        err.alias("error_rate"), comp.alias("compromised"), score.cast("int").alias("risk_score"),
    )
    risk_band = (F.when(F.col("risk_score") >= 5, "High").when(F.col("risk_score") >= 3, "Medium")
                 .otherwise("Low"))
    return out.withColumn("risk_band", risk_band)


def risk_band_counts(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_band").agg(F.count(F.lit(1)).alias("customers")).orderBy("risk_band")


# D-13 -----------------------------------------------------------------------
def fraud_by_channel(labels: DataFrame, txn: DataFrame) -> DataFrame:
    """Labelled transactions per channel and year: labelled, fraud, fraud rate.

    A transaction whose label is null is not labelled.
    """
    j = labels.filter(F.col("Target").isNotNull()).join(txn.select("id", "use_chip", "year"), "id")
    out = j.groupBy("use_chip", "year").agg(
        F.count(F.lit(1)).alias("labelled"),
        F.sum(flag(F.col("Target") == FRAUD_YES)).alias("fraud"),
    )
    return _with_rate(out, "fraud", "labelled", "fraud_rate").orderBy("use_chip", "year")
