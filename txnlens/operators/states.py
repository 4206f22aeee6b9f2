"""Reports on appended data: aggregate states that are kept and merged.

A batch of transactions becomes two small tables. ``days`` has, by day and state,
the counts, the date range and the parts of the money sum (``money_state``), which
merge by addition. ``ids`` has, by year (customers, cards) or state (merchants),
bitmaps of the ids seen: an id's bucket and its bit in the bucket's bitmap, so that
exact distinct counts merge by OR, and no distinct key is shuffled: a task hands on
at most 4 KB for each 32,768 neighbouring ids. That suits ids given in sequence; ids
spread over the whole range take a bitmap each.

``append_states`` writes a batch beside the earlier ones, so only new files are read;
reports over all batches' states equal the reports over all transactions, bit for bit
(as far as amounts are below 1e10, see ``money_state``).
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.numeric import merge_money, money_state, money_value, rate
from txnlens.operators import risk

#: What distinct ids are counted for: kind, id column, column of the group.
ID_KINDS = (("customers", "client_id", "year"), ("cards", "card_id", "year"), ("merchants", "merchant_id", "merchant_state"))


@dataclass(frozen=True)
class States:
    """The states of some transactions; a key may have any number of rows, one a batch."""

    days: DataFrame
    ids: DataFrame

    def union(self, other: States) -> States:
        return States(self.days.unionByName(other.days), self.ids.unionByName(other.ids))

    def compact(self) -> States:
        """One row a key."""
        return States(self.days.groupBy("day", "merchant_state").agg(*_merged_days()),
                      self.ids.groupBy("kind", "part", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")))

    def distinct(self, kind: str, name: str | None = None) -> DataFrame:
        """(part, ``name``): distinct ids of a kind by year or state; a part without ids has no row."""
        per = self.ids.filter(F.col("kind") == kind).groupBy("part", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return per.groupBy("part").agg(F.sum(F.bitmap_count("bits")).alias(name or kind))

    def overview(self) -> DataFrame:
        """``risk.overview`` of all transactions."""
        dates = self.days.agg(F.coalesce(F.sum("transactions"), F.lit(0)).alias("transactions"), F.min("first_date").alias("first_date"),
                              F.max("last_date").alias("last_date"))
        per = self.ids.groupBy("kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits"))
        counts = per.agg(F.struct(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k, _, _ in ID_KINDS]).alias("n"))
        return dates.withColumn("n", counts.scalar()).select("*", "n.*").drop("n")

    def revenue_growth(self) -> DataFrame:
        """``risk.revenue_growth`` of all transactions."""
        per = self._money("year", F.year("day")).join(self.distinct("customers").withColumn("year", F.col("part").cast("int")).drop("part"), "year", "left")
        average = F.col("revenue_or_null") / F.nullif(F.col("amounts"), F.lit(0))
        return risk.with_growth(per.select("year", "transactions", "revenue", average.alias("avg_amount"), F.coalesce("customers", F.lit(0)).alias("customers")))

    def geography(self) -> DataFrame:
        """``risk.geography`` of all transactions."""
        per = self._money("merchant_state", F.col("merchant_state")).join(
            self.distinct("merchants").withColumnRenamed("part", "merchant_state"), "merchant_state", "left")
        return risk.with_volume_rank(per.select("merchant_state", "transactions", "revenue", F.coalesce("merchants", F.lit(0)).alias("merchants")))

    def _money(self, name: str, key) -> DataFrame:
        """Per non-null key: transactions, amounts and revenue."""
        per = self.days.withColumn(name, key).filter(F.col(name).isNotNull()).groupBy(name).agg(*_merged_days())
        return per.withColumn("revenue_or_null", money_value(F.col("money"))).withColumn("revenue", F.coalesce("revenue_or_null", F.lit(0.0)))


def _merged_days():
    return (F.sum("transactions").alias("transactions"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
            F.sum("amounts").alias("amounts"), merge_money("money").alias("money"))


def states(txn: DataFrame) -> States:
    """The states of cleaned transactions with features. Null ids are no ids; null dates and states are groups of their own."""
    days = txn.groupBy(F.to_date("date").alias("day"), "merchant_state").agg(
        F.count(F.lit(1)).alias("transactions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("amount").alias("amounts"), money_state("amount").alias("money"))
    seen = txn.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(part).cast("string").alias("part"), F.col(key).cast("long").alias("id")) for kind, key, part in ID_KINDS])))
    ids = seen.filter("id is not null").groupBy("kind", "part", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return States(days, ids)


def append_states(txn: DataFrame, path: str, batch: str) -> States:
    """Write the states of a batch below ``path`` and return those of all batches there.

    The transactions are read twice, the earlier batches' not at all. A batch that is
    written again takes its own place, so a failed run can be repeated.
    """
    new = states(txn)
    for name, df in (("days", new.days), ("ids", new.ids)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={quote(batch, safe='')}")
    return read_states(txn.sparkSession, path)


def read_states(spark: SparkSession, path: str) -> States:
    """The states of all batches below ``path``."""
    return States(*[spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("days", "ids")])
