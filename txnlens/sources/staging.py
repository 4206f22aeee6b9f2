"""Staging: write a cleaned table once, read it back for many reports.

Reports built on a staged table read Parquet (column pruning, predicate
pushdown, and partition pruning on ``year``) instead of re-reading and
re-cleaning the source files, and the written table cuts the lineage: a lost
executor re-reads the shared files instead of recomputing the cleaning.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.session import checkpoint_dir


def stage(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None,
          mode: str = "error", files_per_value: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a DataFrame reading it back.

    ``path`` defaults to a new folder under the session's shared checkpoint
    folder (``spark.checkpoint.dir``). ``partition_by`` (e.g. ``["year"]``)
    lays the files out by a low-cardinality column for partition pruning.

    Without ``files_per_value`` every task writes one file per value it holds
    (tasks x values files). With it, rows are first shuffled on the partition
    columns plus a salt from a hash of the whole row, so each value is written
    by ``files_per_value`` tasks: a value holding a third of the rows is still
    split evenly, and the salt is deterministic, so a retried task sends every
    row to the same place.
    """
    spark = df.sparkSession
    if path is None:
        path = os.path.join(checkpoint_dir(spark), "staged", uuid.uuid4().hex)
    if partition_by and files_per_value:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_value))
        df = df.repartition(*[F.col(c) for c in partition_by], salt)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # the schema as written: a text partition column would else come back as a number
    return spark.read.schema(df.schema).parquet(path)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def stage_by_id(df: DataFrame, name: str, key: str = "id", buckets: int = 200, path: str | None = None) -> DataFrame:
    """Write ``df`` as table ``name``, bucketed and sorted by a unique ``key``, and return it.

    Tables staged by the same type of key into the same number of buckets join on it
    without an exchange, and aggregate by it without one. One shuffle deals rows by the
    buckets' own hash, so a task writes one file, its bucket. All rows of one key are
    in one bucket: meant for ids that are (nearly) unique, not for a key that a third
    of the rows share; the same holds for rows without a key. Aim for buckets of a few
    hundred MB to 1 GB.

    ``path`` defaults to a new folder under ``spark.checkpoint.dir``; a table or folder
    that exists raises. A session with another catalog finds it by ``read_by_id``.
    """
    spark = df.sparkSession
    if buckets < 1:
        raise ValueError("at least one bucket")
    if path is None:
        path = os.path.join(checkpoint_dir(spark), "staged", uuid.uuid4().hex)
    (df.repartition(buckets, F.col(_quoted(key))).write.format("parquet").mode("error").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(_quoted(name)))
    return spark.table(_quoted(name))


def read_by_id(spark: SparkSession, name: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """The table that ``stage_by_id`` wrote to ``path``, put into this session's catalog as ``name``.

    ``key`` and ``buckets`` are those it was written with: Spark trusts them, since the
    files do not name their columns. The count of buckets is checked against the files.
    """
    files = spark.read.parquet(path)
    # the bucket stands in a file's name: part-…_00007.c000.snappy.parquet; empty buckets have no file
    numbers = [int(f.rsplit("_", 1)[1].split(".")[0]) for f in files.inputFiles() if "_" in os.path.basename(f)]
    if numbers and max(numbers) >= buckets:
        raise ValueError(f"{path} has a bucket {max(numbers)}, so more than {buckets}")
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in files.schema.fields)
    at = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {_quoted(name)} ({columns}) USING parquet CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{at}'")
    return spark.table(_quoted(name))
