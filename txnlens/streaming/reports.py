"""The cleaning, features and grouped reports over a stream of transaction files.

Files dropped into a folder are read with Structured Streaming, go through the
same ``clean_transactions`` / ``txn_features`` projections as the batch jobs,
and feed running aggregations whose state is one row per key (hour of day,
channel and year), so state stays small however long the stream runs. The
query's progress and state live in the folder given to ``start_report``; with the
same shared folder a restarted query, also of another application, resumes where
it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from txnlens.functions.nulls import null_na_strings
from txnlens.operators.cleaning import clean_transactions
from txnlens.operators.features import txn_features
from txnlens.operators.risk import is_error
from txnlens.functions.numeric import money_sum, rate
from txnlens.schemas import TXN


def read_transaction_stream(spark: SparkSession, folder: str, columns: list[str] | None = None,
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned transactions with features.

    ``columns`` is the header order of the files (default: the schema order).
    The header of every file is checked against it (``enforceSchema`` off), so a
    file with another column order fails instead of misplacing values.
    """
    columns = columns or TXN.fieldNames()
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = (spark.readStream.schema(text).option("header", True).option("escape", '"')
              .option("enforceSchema", False))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = null_na_strings(reader.csv(folder))
    typed = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in TXN.fields])
    return txn_features(clean_transactions(typed))


def hourly_error_rates(txn: DataFrame) -> DataFrame:
    """Running transactions, errors and error rate per hour of day."""
    per_hour = txn.filter(F.col("hour").isNotNull()).groupBy("hour").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum(is_error()).alias("errors"))
    return per_hour.withColumn("error_rate", rate("errors", "transactions"))


def channel_volume(txn: DataFrame) -> DataFrame:
    """Running transactions and volume per channel and year."""
    return txn.filter(F.col("use_chip").isNotNull() & F.col("year").isNotNull()).groupBy(
        "use_chip", "year").agg(F.count(F.lit(1)).alias("transactions"),
                                money_sum("amount").alias("total_volume"))


def start_report(report: DataFrame, name: str, checkpoint: str, sink: str = "memory",
                 path: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a report in ``complete`` mode.

    ``sink='memory'`` exposes it as the table ``name``; other sinks (``parquet``
    via ``foreachBatch`` overwrite, for example) take ``path``.
    """
    writer = report.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    if sink == "memory":
        return writer.format("memory").queryName(name).start()
    if sink == "parquet":
        if not path:
            raise ValueError("parquet sink needs a path")

        def overwrite(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        return writer.foreachBatch(overwrite).start()
    raise ValueError(f"unknown sink {sink!r}")
