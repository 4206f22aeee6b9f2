"""Banking tables derived from the generic benchmark tables.

The test data is a star schema (``events``, ``customer``, ``nation``, ``region``,
``part``); these functions derive the four banking tables plus fraud labels
from it, so every report runs on data whose size grows with the scale factor.
The definitions are ours and are documented in FIXTURES.md; the oracle SQL in
``txnlens.plans.oracle`` states them a second time, independently, for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Schemas of the benchmark tables the adapters read. Declaring them skips the
# footer-reading job that schema inference would run for every read, and a
# file whose columns changed type fails at the scan instead of deep in a plan.
TABLE_SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
              "props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if name not in TABLE_SCHEMAS:
        return spark.read.parquet(path)
    df = spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)
    # a column that the files lack would read as null: one footer says so once per session and folder
    key = (spark.sparkContext.applicationId, path)
    if key not in _CHECKED:
        missing = set(df.columns) - set(spark.read.parquet(path).columns)
        if missing:
            raise ValueError(f"{path} has no columns {sorted(missing)}")
        _CHECKED.add(key)
    return df


_CHECKED: set[tuple[str, str]] = set()


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # region has 5 rows by definition of the schema: a fixed-size broadcast
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", "n_name", "r_name"
    )


def txn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as they would arrive from the source CSV (amount as text).

    The place is a nation picked by ``event_id % 25``, so every event is a transaction
    and only the 25-row lookup is joined.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # nation has 25 rows by definition of the schema: a fixed-size broadcast
    geo = F.broadcast(_geography(spark, sf_dir))
    j = events.join(geo, (F.col("event_id") % 25).cast("int") == geo.n_nationkey, "left")

    eid = F.col("event_id")
    online = (eid % 3) == 2
    value = F.col("value")
    amount = (
        F.when(eid % 53 == 0, F.lit("n.a."))
        .when(eid % 11 == 0, F.concat(F.lit("-"), value.cast("string")))
        .otherwise((F.lit(2) * value).cast("string"))
    )
    use_chip = (
        F.when(eid % 3 == 0, F.lit("Swipe Transaction"))
        .when(eid % 3 == 1, F.lit("Chip Transaction"))
        .otherwise(F.lit("Online Transaction"))
    )
    error_kind = (
        F.when(eid % 4 == 0, F.lit("Bad PIN"))
        .when(eid % 4 == 1, F.lit("Insufficient Balance"))
        .when(eid % 4 == 2, F.lit("Technical Glitch"))
        .otherwise(F.lit("Bad CVV"))
    )
    return j.select(
        eid.alias("id"),
        (F.col("ts") - F.make_ym_interval(F.lit(0), (eid % 120).cast("int"))).alias("date"),
        F.when(eid % 211 != 0, F.col("user_id")).alias("client_id"),
        # customers have cards 0 to 3; a transaction in five names a card that nobody has
        (F.col("user_id") * 10 + eid % 5).alias("card_id"),
        amount.alias("amount"),
        use_chip.alias("use_chip"),
        F.when(online, F.lit("ONLINE")).otherwise(F.col("n_name")).alias("merchant_city"),
        F.when(~online, F.col("r_name")).alias("merchant_state"),
        F.when(eid % 7 != 0, (F.lit(10000) + F.col("n_nationkey")).cast("double")).alias("zip"),
        (eid % 97).alias("merchant_id"),
        (F.lit(4990) + eid % 40).cast("int").alias("mcc"),
        F.when(F.col("event_type") == "error", error_kind).alias("errors"),
    )


def users_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with money columns as ``$``-prefixed text."""
    c = F.col("c_custkey")

    def money(v):
        return F.concat(F.lit("$"), v.cast("string"))

    yearly = (
        F.when(c % 97 == 0, F.lit(0))
        .when(c % 101 == 0, F.lit(400000))
        .when(c % 103 == 0, F.lit(-90000))
        .otherwise(F.lit(10000) + (c * 7919) % 80000)
    )
    return table(spark, sf_dir, "customer").select(
        c.alias("id"),
        (F.lit(18) + c % 70).cast("int").alias("current_age"),
        (F.lit(60) + c % 11).cast("int").alias("retirement_age"),
        F.when(c % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        money(F.lit(5000) + (c * 7919) % 40000).alias("per_capita_income"),
        money(yearly).alias("yearly_income"),
        money((c * 104729) % 150000).alias("total_debt"),
        (F.lit(300) + (c * 37) % 551).cast("int").alias("credit_score"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cards per customer (k = 0..3), generated per row without a join."""
    c, k = F.col("c_custkey"), F.col("k")
    per_card = table(spark, sf_dir, "customer").select(
        "c_custkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k")
    )
    return per_card.select(
        (c * 10 + k).alias("id"),
        c.alias("client_id"),
        F.date_add(F.lit("2005-01-01").cast("date"), ((c * 13 + k) % 3000).cast("int"))
        .cast("timestamp_ntz").alias("acct_open_date"),
        F.date_add(F.lit("2012-01-01").cast("date"), ((c * 7 + k * 31) % 4000).cast("int"))
        .cast("timestamp_ntz").alias("expires"),
        F.when((c + k) % 5 == 0, F.lit("NO")).otherwise(F.lit("YES")).alias("has_chip"),
        F.when(k == 0, F.lit("Credit")).when(k == 3, F.lit("Debit (Prepaid)"))
        .otherwise(F.lit("Debit")).alias("card_type"),
        F.when((c * 3 + k) % 19 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("card_on_dark_web"),
    )


def mcc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant category lookup: one code for each part, from 5000 on (transactions use 4990 to 5029)."""
    return table(spark, sf_dir, "part").select(
        (F.lit(5000) + F.col("p_partkey")).cast("int").alias("code"),
        F.col("p_type").alias("description"),
    )


def fraud_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud labels: one row for each transaction, the label null for a fifth of them."""
    eid = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        eid.alias("id"),
        F.when(eid % 5 == 1, F.lit(None).cast("string"))
        .when((F.col("event_type") == "error") & (eid % 5 == 0), F.lit("Yes"))
        .otherwise(F.lit("No")).alias("Target"),
    )


def transactions_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as a CSV's text columns, with missing markers, bad dates and bad ids by key."""
    eid = F.col("id")
    t = txn_raw(spark, sf_dir)
    text = {c: F.col(c).cast("string") for c in t.columns}
    text["date"] = (F.when(eid % 29 == 0, "soon").when(eid % 31 == 0, "NaN")
                    .otherwise(F.date_format(F.col("date").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")))
    text["client_id"] = F.when(eid % 37 == 0, "x").when(F.col("client_id").isNull(), "n/a").otherwise(text["client_id"])
    text["zip"] = F.when(F.col("zip").isNull(), "NA").otherwise(text["zip"])
    text["errors"] = F.coalesce(F.col("errors"), F.lit(""))
    return t.select(*[v.alias(c) for c, v in text.items()])


def users_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users as a CSV's text columns, with missing markers, bad ages and bad scores by key."""
    c = F.col("id")
    u = users_raw(spark, sf_dir)
    text = {n: F.col(n).cast("string") for n in u.columns}
    text["current_age"] = F.when(c % 41 == 0, "unknown").when(c % 43 == 0, "NaN").otherwise(text["current_age"])
    text["credit_score"] = F.when(c % 47 == 0, "n/a").when(c % 53 == 0, "7e2x").otherwise(text["credit_score"])
    return u.select(*[v.alias(n) for n, v in text.items()])


def cards_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards as a CSV's text columns, with dates as month and year, bad dates and missing flags by key."""
    c = F.col("id")
    k = cards(spark, sf_dir)
    text = {n: F.col(n).cast("string") for n in k.columns}
    for n in ("acct_open_date", "expires"):
        text[n] = F.date_format(F.col(n).cast("timestamp"), "MM/yyyy")
    text["expires"] = F.when(c % 23 == 0, "never").otherwise(text["expires"])
    text["card_on_dark_web"] = F.when(c % 29 == 0, "null").otherwise(text["card_on_dark_web"])
    return k.select(*[v.alias(n) for n, v in text.items()])


def mcc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category codes as a CSV's text columns, with bad codes and missing descriptions by key."""
    c = F.col("code")
    return mcc_codes(spark, sf_dir).select(
        F.when(c % 19 == 0, F.concat(F.lit("#"), c.cast("string"))).otherwise(c.cast("string")).alias("code"),
        F.when(c % 17 == 0, "None").otherwise(F.col("description")).alias("description"))


def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fraud labels as pieces of one JSON object, split at commas (column ``value``)."""
    labels = fraud_labels(spark, sf_dir)
    label = F.when(F.col("Target").isNull(), "null").when(F.col("Target") == "Yes", '"\\u0059es"').otherwise('"No"')
    pair = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": '), label)
    return labels.select(F.when(F.col("id") == 0, F.concat(F.lit('{"target": {'), pair)).otherwise(pair).alias("value"))
