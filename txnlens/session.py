"""Session-level settings the library reads (never overrides when already set)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one already
    set on the context). Only a local-mode session without one (tests, a
    laptop) gets a folder below its own ``spark.local.dir``; a cluster session without
    one is an error, because executors cannot share a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = f"{sc.getConf().get('spark.local.dir', '/tmp')}/txnlens-checkpoint-{sc.applicationId}"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def reliable_checkpoint(df):
    """Checkpoint ``df`` to the shared checkpoint folder and return the checkpointed frame.

    ``df`` is persisted while its checkpoint is written, so the write does not
    recompute it, and released right after; the result reads the written files.
    """
    checkpoint_dir(df.sparkSession)
    cached = df.persist()
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()
