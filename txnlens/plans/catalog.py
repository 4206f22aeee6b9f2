"""Named reports, over any ``Tables``, and the driver's queries over benchmark tables.

``REPORTS`` maps each report name to a function of ``Tables`` returning a lazy
DataFrame. ``QUERIES`` binds the same reports to the benchmark tables in a
folder: ``(spark, sf_dir) -> DataFrame``. Read, adapt, clean, features and the
report form one logical plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.numeric import round_half_even, round_significant
from txnlens.operators import aggregates as agg
from txnlens.operators import binning, correlation, heavy, profile, quantiles, risk
from txnlens.operators import states as st
from txnlens.operators.features import CARD_FEATURES, TXN_FEATURES, USER_FEATURES
from txnlens.plans.tables import Tables
from txnlens.schemas import CARDS, MCC, TXN, USERS
from txnlens.sources.files import label_pairs, text_failures, typed_columns

DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"

Report = Callable[[Tables], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]


def _both(report) -> Report:
    return lambda t: report(t.raw_transactions, "transactions").unionByName(report(t.raw_users, "users"))


def _significant(report: DataFrame, columns) -> DataFrame:
    """Float statistics to 11 significant digits: their last bits depend on how partial results merge."""
    return report.withColumns({c: round_significant(c) for c in columns})


MEANS = {"gender_means": ("per_capita_income", "yearly_income", "total_debt", "debt_to_income"),
         "retired_means": ("yearly_income", "total_debt", "credit_score")}

REPORTS: dict[str, Report] = {
    # profiling
    "table_shape": _both(profile.table_shape),
    "table_info": _both(profile.table_info),
    "table_head": lambda t: profile.table_head(t.raw_transactions, "id"),
    "users_head": lambda t: profile.table_head(t.raw_users, "id"),
    "txn_features_head": lambda t: profile.table_head(t.transactions, "id").select("id", *TXN_FEATURES),
    "user_features_head": lambda t: profile.table_head(t.users, "id").select("id", *USER_FEATURES),
    "card_features_head": lambda t: profile.table_head(t.cards, "id").select("id", *CARD_FEATURES),
    "null_counts": lambda t: profile.null_counts(t.clean_transactions, "transactions").unionByName(
        profile.null_counts(t.clean_users, "users")),
    "duplicate_rows": lambda t: profile.duplicate_rows(t.clean_users, "users").unionByName(
        profile.duplicate_rows(t.clean_users.select("current_age", "retirement_age", "gender"), "users_age_gender")),
    "describe_users": lambda t: _significant(profile.describe(t.users), ("mean", "std")),
    "describe_credit_score": lambda t: _significant(profile.describe(t.users, ["credit_score"]), ("mean", "std")),
    # cleaning and features
    "clean_transactions": lambda t: t.clean_transactions,
    "clean_users": lambda t: t.clean_users,
    "txn_features": lambda t: t.transactions,
    "user_features": lambda t: t.users,
    "card_features": lambda t: t.cards,
    # transaction reports
    "txn_by_channel": lambda t: agg.txn_by_channel(t.transactions),
    "txn_by_year": lambda t: agg.txn_by_year(t.transactions),
    "busiest_hours": lambda t: agg.busiest_hours(t.transactions),
    "top_states": lambda t: agg.top_states(t.transactions),
    "top_cities": lambda t: agg.top_cities(t.transactions),
    "customer_summary": lambda t: agg.customer_summary(t.transactions),
    "top_spenders": lambda t: agg.top_spenders(t.transactions),
    "most_active_customers": lambda t: agg.most_active_customers(t.transactions),
    "error_types": lambda t: agg.error_types(t.transactions),
    # quantiles and outliers
    "amount_quantiles": lambda t: quantiles.quartiles(t.transactions, "amount"),
    "income_quantiles": lambda t: quantiles.quartiles(t.users, "yearly_income"),
    "iqr_bounds": lambda t: quantiles.iqr_bounds(t.transactions, "amount").unionByName(
        quantiles.iqr_bounds(t.users, "yearly_income")),
    "amount_low_outliers": lambda t: quantiles.outlier_shape(t.transactions, "amount", "low"),
    "amount_high_outliers": lambda t: quantiles.outlier_shape(t.transactions, "amount", "high"),
    "income_high_outliers": lambda t: quantiles.outliers(t.users, "yearly_income", "high"),
    "income_low_outliers": lambda t: quantiles.outliers(t.users, "yearly_income", "low"),
    # users
    "gender_counts": lambda t: agg.gender_counts(t.users),
    "gender_means": lambda t: _significant(agg.gender_means(t.users), MEANS["gender_means"]),
    "credit_bands": lambda t: binning.credit_bands(t.users),
    "retired_means": lambda t: _significant(agg.retired_means(t.users), MEANS["retired_means"]),
    "user_correlations": lambda t: correlation.user_correlations(t.users).withColumn("r", round_half_even("r", 9)),
    # labels
    "label_counts": lambda t: agg.label_counts(t.labels),
    "label_shares": lambda t: agg.label_shares(t.labels),
    # described analysis areas
    "overview": lambda t: risk.overview(t.transactions),
    "revenue_growth": lambda t: risk.revenue_growth(t.transactions),
    "error_rate_by_type": lambda t: risk.error_rate_by_type(t.transactions),
    "high_risk_customers": lambda t: risk.high_risk_customers(t.transactions),
    "high_value_errors": lambda t: risk.high_value_errors(t.transactions),
    "dark_web_cards": lambda t: risk.dark_web_cards(t.transactions, t.cards),
    "unmatched_card_transactions": lambda t: risk.unmatched_card_transactions(t.transactions, t.cards),
    "channel_mix_by_year": lambda t: risk.channel_mix_by_year(t.transactions),
    "channel_mix_wide": lambda t: risk.channel_mix_wide(t.transactions),
    "customer_tiers": lambda t: risk.customer_tiers(t.transactions),
    "tier_summary": lambda t: risk.tier_summary(risk.customer_tiers(t.transactions)),
    "geography": lambda t: risk.geography(t.transactions),
    "merchant_categories": lambda t: risk.merchant_categories(t.transactions, t.mcc),
    "refund_summary": lambda t: risk.refund_summary(t.transactions),
    "refund_customers": lambda t: risk.refund_customers(t.transactions),
    "error_rate_by_hour": lambda t: risk.error_rate_by_hour(t.transactions),
    "error_rate_night": lambda t: risk.error_rate_night(t.transactions),
    "chip_vs_swipe_errors": lambda t: risk.chip_vs_swipe_errors(t.transactions),
    "dark_web_by_card_type": lambda t: risk.dark_web_by_card_type(t.cards),
    "customer_risk": lambda t: risk.customer_risk(t.users, t.transactions, t.cards),
    "risk_band_counts": lambda t: risk.risk_band_counts(risk.customer_risk(t.users, t.transactions, t.cards)),
    "fraud_by_channel": lambda t: risk.fraud_by_channel(t.labels, t.transactions),
}

# The benchmark tables of a folder are built once per session (the key holds the
# application id, so a new session never sees another's plans); ``forget``
# drops them, e.g. after the files changed.
_BENCHMARK: dict[tuple, Tables] = {}


def benchmark_tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    tables = _BENCHMARK.get(key)
    if tables is None:
        tables = _BENCHMARK[key] = Tables.from_benchmark(spark, sf_dir)
    return tables


def forget() -> None:
    """Drop the shared benchmark-table plans."""
    _BENCHMARK.clear()


def _bind(report: Report) -> Query:
    return lambda spark, sf_dir: report(benchmark_tables(spark, sf_dir))


# the readers' second half, over text columns as the file readers give them
PARSING: dict[str, Report] = {
    "parse_transactions": lambda t: typed_columns(t.transactions_text, TXN, DATE_FORMAT),
    "parse_failures": lambda t: text_failures(t.transactions_text, TXN, DATE_FORMAT),
    "parse_users": lambda t: typed_columns(t.text("users"), USERS),
    "parse_cards": lambda t: typed_columns(t.text("cards"), CARDS, "MM/yyyy"),
    "parse_mcc": lambda t: typed_columns(t.text("mcc"), MCC),
    "parse_labels": lambda t: label_pairs(t.label_text),
}



def _merged(t: Tables) -> st.States:
    """The states of three batches of the transactions, put together."""
    batches = [st.states(t.transactions.filter(F.col("id") % 3 == i)) for i in range(3)]
    return batches[0].union(batches[1]).union(batches[2])


# reports from merged states of batches: the same rows as from all transactions
MERGED: dict[str, Report] = {
    "overview_merged": lambda t: _merged(t).overview(),
    "revenue_growth_merged": lambda t: _merged(t).revenue_growth(),
    "geography_merged": lambda t: _merged(t).geography(),
}

# top-k reports that shuffle only the keys that can be among the first: the same rows as the plain ones
HEAVY: dict[str, Report] = {
    "heavy_spenders": lambda t: heavy.heavy_spenders(t.transactions),
    "heavy_customers": lambda t: heavy.heavy_customers(t.transactions),
    "heavy_states": lambda t: heavy.heavy_places(t.transactions, "merchant_state"),
    "heavy_cities": lambda t: heavy.heavy_places(t.transactions, "merchant_city"),
}

QUERIES: dict[str, Query] = {name: _bind(report) for name, report in {**REPORTS, **PARSING, **MERGED, **HEAVY}.items()}


# Shortcuts used by tests and scripts.
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_tables(spark, sf_dir).transactions


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_tables(spark, sf_dir).users


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_tables(spark, sf_dir).cards
