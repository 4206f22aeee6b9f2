"""Inputs of the operators: the synthetic tables and helpers shared by their queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text, whatever other columns the table has."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    Only a session whose executors are threads of the driver may leave the setting out;
    its folder is below ``spark.local.dir``.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{sc.getConf().get('spark.local.dir', '/tmp')}/txnlens-{sc.applicationId}"
    return f"{base.rstrip('/')}/txnlens-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Keys that may be broadcast (8 bytes each and a hash table's overhead).
BROADCAST_KEYS = 500_000


def only(df: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is one of ``keys`` (one column, already cut): by broadcast up to BROADCAST_KEYS, else by a shuffle."""
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, key, "left_semi")
