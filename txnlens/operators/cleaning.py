"""Cleaning steps for transactions and users.

Each function returns a new DataFrame from a single projection: Catalyst folds
all steps (and the feature columns added later) into one ``Project`` with no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.numeric import strip_currency, to_number
from txnlens.schemas import CURRENCY_SYMBOL, MONEY_COLUMNS, NO_ERRORS, ONLINE


def clean_transactions(txn: DataFrame, currency_symbol: str | None = None) -> DataFrame:
    """Amount to number, fill state/errors, zero the zip of online and unknown places.

    * ``amount``: text to double; unparsable or non-finite -> null.
    * ``merchant_state``: null -> ``ONLINE``.
    * ``errors``: null -> ``No Errors``.
    * ``zip``: 0 where ``merchant_city == 'ONLINE'`` (overrides any value), else
      the value, else 0.
    """
    city = F.col("merchant_city")
    return txn.withColumns({
        "amount": to_number("amount", currency_symbol),
        "merchant_state": F.coalesce(F.col("merchant_state"), F.lit(ONLINE)),
        "errors": F.coalesce(F.col("errors"), F.lit(NO_ERRORS)),
        "zip": F.when(city == ONLINE, F.lit(0.0)).otherwise(F.coalesce(F.col("zip"), F.lit(0.0))),
    })


def clean_users(users: DataFrame, money_columns=MONEY_COLUMNS, symbol: str = CURRENCY_SYMBOL) -> DataFrame:
    """Strip the currency symbol from the money columns and cast to double.

    A value that is not a number after stripping fails the job.
    """
    return users.withColumns({c: strip_currency(c, symbol) for c in money_columns})
