"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset in local mode."""
    context = spark.sparkContext
    if held := context.getCheckpointDir():
        return held
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: later jobs read it, and lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
