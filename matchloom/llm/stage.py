"""Cutting lineage in the shared folder that the session names."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset in local mode."""
    context = spark.sparkContext
    held = context.getCheckpointDir()
    if held:
        return held
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of an earlier stage, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: later jobs read it, and lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, matched by exact name; columns that are extra or clash in case don't reach the operator."""
    return by_position(df, *columns)[0].select(*columns)


def by_position(df: DataFrame, *columns: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the named columns as they are and all others under names that can't clash, and a function that gives a result its old columns back.

    The first of several columns of one name counts.
    """
    names = df.columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    at = {names.index(c) for c in columns}
    plain = [c if i in at else f"_column{i}_" for i, c in enumerate(names)]
    return df.toDF(*plain), lambda out: out.select(*plain).toDF(*names)
