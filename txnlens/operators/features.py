"""Derived columns for transactions, users and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.dates import whole_days
from txnlens.functions.numeric import flag, round_half_even, safe_ratio
from txnlens.schemas import CHIP_YES, HIGH_VALUE_THRESHOLD, ONLINE

TXN_FEATURES = ("year", "month", "hour", "is_online", "is_refund", "is_high_value")
USER_FEATURES = ("years_to_retirement", "is_retired", "debt_to_income")
CARD_FEATURES = ("account_duration_days", "is_chip_enabled")


def txn_features(txn: DataFrame) -> DataFrame:
    """Calendar parts of ``date`` and 0/1 flags; expects a cleaned frame.

    ``is_online`` looks at the city (not the filled state); flags are 0 when the
    compared value is null.
    """
    amount = F.col("amount")
    return txn.withColumns({
        "year": F.year("date"),
        "month": F.month("date"),
        "hour": F.hour("date"),
        "is_online": flag(F.col("merchant_city") == ONLINE),
        "is_refund": flag(amount < 0),
        "is_high_value": flag(amount > HIGH_VALUE_THRESHOLD),
    })


def user_features(users: DataFrame) -> DataFrame:
    """Years to retirement (floored at 0, null kept), retired flag, debt/income ratio."""
    gap = F.col("retirement_age") - F.col("current_age")
    return users.withColumns({
        "years_to_retirement": F.when(gap < 0, F.lit(0)).otherwise(gap),
        "is_retired": flag(F.col("current_age") >= F.col("retirement_age")),
        "debt_to_income": round_half_even(safe_ratio("total_debt", "yearly_income"), 2),
    })


def card_features(cards: DataFrame) -> DataFrame:
    """Account duration in whole (floored) days and the chip flag."""
    return cards.withColumns({
        "account_duration_days": whole_days("acct_open_date", "expires"),
        "is_chip_enabled": flag(F.col("has_chip") == CHIP_YES),
    })
