"""Sinks: append-only tables and text reports."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import canonical_json, strip
from .files import IMPORT_COLUMNS


def append(df: DataFrame, path: str, *partition: str) -> None:
    """Appended Parquet, partitioned by tenant."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def _path(spark: SparkSession, name: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _path(spark, new)
    fs.mkdirs(at.getParent())
    if not fs.rename(_path(spark, old)[1], at):
        raise OSError(f"{old} can't become {new}")


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    fs, at = _path(spark, f"{path}/_manifests/{batch}.json")
    return fs.exists(at)


def commit_batch(tables: dict[str, DataFrame], path: str, batch: str, *partition: str) -> bool:
    """Appends one batch to several tables, all or nothing; False if the batch is stored already.

    The tables are staged, moved to ``<path>/<table>/batch=<batch>``, and only then
    does a manifest name the batch.  Readers take batches with a manifest alone
    (`read_committed`), so whatever a lost driver leaves is not read, and a retry
    under the same name, such as a run's id or an epoch, puts it in place of that.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch is named by letters, digits, dots, dashes and underscores")
    spark = next(iter(tables.values())).sparkSession
    if committed(spark, path, batch):
        return False
    staged = f"{path}/_staged/{batch}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.partitionBy(*partition).parquet(f"{staged}/{name}")
    for name in tables:
        fs, left = _path(spark, f"{path}/{name}/batch={batch}")
        fs.delete(left, True)  # of an attempt that wasn't committed
        _rename(spark, f"{staged}/{name}", f"{path}/{name}/batch={batch}")
    fs, at = _path(spark, f"{path}/_manifests/{batch}.json")
    out = fs.create(at, False)  # the commit: fails if another writer was first
    out.write(bytearray(json.dumps({"batch": batch, "tables": sorted(tables)}).encode()))
    out.close()
    fs.delete(_path(spark, staged)[1], True)
    return True


def read_committed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of committed batches, with the column batch."""
    fs, at = _path(spark, f"{path}/_manifests")
    names = [x.getPath().getName().removesuffix(".json") for x in fs.listStatus(at)] if fs.exists(at) else []
    if not names:
        raise ValueError(f"nothing is committed in {path}")
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/batch={n}" for n in sorted(names)])


def append_shortlists(runs: DataFrame, entries: DataFrame, path: str, limit: int = 20, batch: str | None = None) -> bool:
    """Runs and their entries as one committed batch of two tables by organisation; False if it is stored already.

    Nothing is written if a run has more than ``limit`` entries or shortlists
    more than are eligible, or if a run of the same id and organisation has entries twice at one rank.
    The batch is named by the runs' ids unless a name, such as a stream's epoch, is given.
    """
    bad = entries.groupBy("run_id").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("rank").alias("ranks")).filter((F.col("n") > limit) | (F.col("top") > limit) | (F.col("ranks") < F.col("n")))
    if not bad.isEmpty() or not runs.filter("shortlisted > eligible or eligible > evaluated").isEmpty():
        raise ValueError("runs or entries break the shortlist rules")
    if batch is None:
        ids = runs.agg(F.count("*"), F.bit_xor(F.xxhash64("org_id", "run_id")), F.bit_xor(F.xxhash64(F.lit(1), "org_id", "run_id"))).first()
        batch = "runs-" + "-".join(f"{(x or 0) & (2**64 - 1):x}" for x in ids)
    return commit_batch({"runs": runs, "entries": entries}, path, batch, "org_id")


def append_events(events: DataFrame, path: str, batch: str) -> bool:
    """Cleaned ledger events as one committed batch by organisation; False if it is stored already."""
    return commit_batch({"events": clean_event(events)}, path, batch, "org_id")


def json_lines(df: DataFrame, path: str) -> None:
    """Compact JSON with sorted names, nulls kept, one line a row."""
    df.select(canonical_json(df).alias("value")).write.mode("overwrite").text(path)


def metric_line(label: str, value: Column, known: Column, total: Column) -> Column:
    """S9: 'label: value', or how many of how many are there where the value is unavailable."""
    missing = F.format_string("unavailable (%d/%d)", known, total)
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), missing))


def draft_text(subject: Column, body: Column) -> Column:
    """S10."""
    return F.concat(F.lit("Subject: "), strip(subject), F.lit("\n\n"), strip(body), F.lit("\n"))


def export_drafts(drafts: DataFrame, path: str) -> None:
    """One text for each approved draft, a folder for each."""
    # the writer ends each value with a line feed, so the text goes without its own
    value = F.regexp_replace(draft_text(F.col("subject"), F.col("body")), r"\n\z", "")
    drafts.filter("approved").select("draft_id", value.alias("value")).write.mode("overwrite").partitionBy("draft_id").text(path)


def clean_event(df: DataFrame) -> DataFrame:
    """Texts cut to 255 characters, negative counts, durations and costs to null, decimals with 3 and 9 digits."""
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if f.name in ("duration_ms", "estimated_cost_usd"):
            x = F.col(f.name).cast("double") if kind == "string" else F.col(f.name)
            x = F.when(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), None).otherwise(x) if kind in ("double", "float", "string") else x
            digits = 3 if f.name == "duration_ms" else 9
            out[f.name] = F.when(x >= 0, F.round(x.cast(f"decimal(27,{digits + 3})"), digits)).cast(f"decimal({16 if digits == 3 else 18},{digits})")
        elif kind == "string":
            out[f.name] = F.substring(strip(F.col(f.name)), 1, 255)
        elif f.name.endswith("_tokens") or f.name == "retries_used":
            out[f.name] = F.when(F.col(f.name) >= 0, F.col(f.name))
    return df.withColumns(out)


def csv_template(spark: SparkSession, path: str) -> None:
    """A CSV of the header alone."""
    spark.createDataFrame([(",".join(IMPORT_COLUMNS),)], "value string").coalesce(1).write.mode("overwrite").text(path)
