"""Schemas of the input tables and the fixed values the reports depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must stay exactly as written for results to agree with
# the pandas analysis this library re-implements.
# ---------------------------------------------------------------------------

# Strings that pandas.read_csv reads as missing by default.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Fill values of the cleaning step.
ONLINE = "ONLINE"
NO_ERRORS = "No Errors"
# A transaction is high value when its amount is strictly above this.
HIGH_VALUE_THRESHOLD = 500
# Cards whose has_chip equals this are chip enabled.
CHIP_YES = "YES"
# Money columns of the users table carry this prefix.
CURRENCY_SYMBOL = "$"
MONEY_COLUMNS = ("per_capita_income", "yearly_income", "total_debt")
# Credit score bands: right-closed intervals (lo, hi], lowest edge excluded.
CREDIT_EDGES = (300, 579, 669, 739, 799, 850)
CREDIT_LABELS = ("Poor", "Fair", "Good", "Very Good", "Exceptional")
# Tukey fences.
IQR_FACTOR = 1.5
# Customer tier names, best first.
TIER_NAMES = ("Platinum", "Gold", "Silver", "Bronze", "Standard")
# Card flag value meaning "listed on the dark web".
DARK_WEB_YES = "Yes"
# Fraud label value meaning "fraud".
FRAUD_YES = "Yes"

# A plain decimal number: optional sign, digits with optional point, optional
# exponent, optional surrounding blanks. Anything else is not a number.
NUM_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# The same as Python's float() reads it (what astype(float) uses): digits may
# also be grouped by single underscores, in the mantissa and the exponent.
FLOAT_TEXT_PATTERN = r"^\s*[+-]?(\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*$"

# ---------------------------------------------------------------------------
# Typed schemas (column name -> Spark type). Readers cast by name.
# ---------------------------------------------------------------------------

TXN = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("card_id", T.LongType()),
    # kept as text until the cleaning step coerces it
    T.StructField("amount", T.StringType()),
    T.StructField("use_chip", T.StringType()),
    T.StructField("merchant_id", T.LongType()),
    T.StructField("merchant_city", T.StringType()),
    T.StructField("merchant_state", T.StringType()),
    T.StructField("zip", T.DoubleType()),
    T.StructField("mcc", T.IntegerType()),
    T.StructField("errors", T.StringType()),
])

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("current_age", T.IntegerType()),
    T.StructField("retirement_age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    # "$1234" text until clean_users strips the symbol
    T.StructField("per_capita_income", T.StringType()),
    T.StructField("yearly_income", T.StringType()),
    T.StructField("total_debt", T.StringType()),
    T.StructField("credit_score", T.IntegerType()),
])

CARDS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("acct_open_date", T.TimestampNTZType()),
    T.StructField("expires", T.TimestampNTZType()),
    T.StructField("has_chip", T.StringType()),
    T.StructField("card_type", T.StringType()),
    T.StructField("card_on_dark_web", T.StringType()),
])

MCC = T.StructType([
    T.StructField("code", T.IntegerType()),
    T.StructField("description", T.StringType()),
])

LABELS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("Target", T.StringType()),
])
