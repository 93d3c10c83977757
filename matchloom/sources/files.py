"""Sources: candidate CSV, frozen datasets, documents and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.normalize import strip
from . import strict_csv

IMPORT_COLUMNS = tuple(field.split()[0] for field in schemas.IMPORT.split(","))


def check_header(names: list[str]) -> list[str]:
    """The trimmed header, or an error for an empty, repeated, missing or unknown column."""
    clean = [n.strip().lstrip("﻿") for n in names]
    if not clean or clean == [""]:
        raise ValueError("the CSV is empty or has no header row")
    if len(set(clean)) < len(clean):
        raise ValueError("the CSV contains duplicate column headers")
    if "full_name" not in clean:
        raise ValueError("missing required column: full_name")
    if odd := sorted(set(clean) - set(IMPORT_COLUMNS)):
        raise ValueError("unsupported column(s): " + ", ".join(odd))
    return clean


def candidate_csv(spark: SparkSession, path: str) -> DataFrame:
    """The allowed columns (missing ones empty), row_number from 2 in file order, and extra_values.

    Quoting is strict, and files are read in blocks (`strict_csv`).  A file with
    malformed quoting, null bytes or bytes that aren't UTF-8 is an error, as are
    files of different headers.  Empty lines have no number; rows of blanks have
    one and are left out.  Rows with more values than the header carry
    extra_values and reject the import.
    """
    rows = strict_csv.lines(spark, path)
    known = strict_csv.blocks(rows)
    if bad := known.filter("fault is not null").select("file", "fault").distinct().limit(5).collect():
        raise ValueError("the CSV is not valid: " + ", ".join(f"{r.file} is {r.fault}" for r in bad))
    # the header ends in one of the blocks that no row ends before
    reach = known.filter(F.col("first") == 0).agg(F.max("block")).first()[0] or 0
    first = strict_csv.records(rows.filter(F.col("block") <= reach), known).filter(F.col("number") == 0).select("values").distinct().limit(2).collect()
    if len(first) > 1:
        raise ValueError("the files have different header rows")
    header = check_header(first[0][0] if first else [])
    values = strict_csv.records(rows, known).filter(F.col("number") > 0)
    cols = [F.coalesce(F.get("values", F.lit(header.index(n))), F.lit("")).alias(n) if n in header else F.lit("").alias(n) for n in IMPORT_COLUMNS]
    out = values.select((F.size("values") > len(header)).alias("extra_values"), *cols, (F.col("number") + 1).alias("row_number"))
    blank = F.forall(F.array(*IMPORT_COLUMNS), lambda x: strip(x) == "")
    return out.filter(~blank | F.col("extra_values"))


def frozen_dataset(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row for each dataset file, with its schema fixed."""
    return spark.read.schema(schemas.DATASET).option("multiLine", True).json(path)


def dataset_issues(dataset: DataFrame) -> DataFrame:
    """S3: codes that are malformed or repeated, and vacancies that don't judge every candidate."""
    codes = F.transform("candidates", lambda c: c["code"])
    rows = dataset.select("dataset_id", codes.alias("codes"), F.explode("vacancies").alias("v"))
    checks = [
        (F.exists("codes", lambda c: ~c.rlike("^[A-Z][0-9]{2}$")), "candidate_code_malformed"), (F.size(F.array_distinct("codes")) < F.size("codes"), "candidate_code_repeated"),
        (~F.col("v.code").rlike("^[A-Z][0-9]{2}$"), "vacancy_code_malformed"), (F.size(F.array_except("codes", F.map_keys("v.relevance_judgments"))) > 0, "judgment_missing"),
        (F.size(F.array_except(F.map_keys("v.relevance_judgments"), "codes")) > 0, "judgment_unknown"), (F.exists(F.map_values("v.relevance_judgments"), lambda g: ~g.between(0, 3)), "grade_out_of_range"),
    ]
    return rows.select("dataset_id", F.col("v.code").alias("vacancy"), F.explode(F.array_compact(F.array(*[F.when(c, n) for c, n in checks]))).alias("issue"))


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, content, size_bytes and sha256 of stored files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("path"), "content", F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table read with its declared schema, never an inferred one."""
    return spark.read.schema(schema).parquet(path)


def decode_json(column: Column, schema: T.DataType | str) -> Column:
    """Struct of value and error; text that isn't JSON of the schema's kind gives not_decodable."""
    simple = schema if isinstance(schema, str) else schema.simpleString()
    # within an object of its own the text can be told to be corrupt whatever its kind
    whole = F.from_json(F.concat(F.lit('{"v":'), column, F.lit("}")), f"v {simple}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    opens = r"^\s*\[" if simple.startswith("array") else r"^\s*\{"
    bad = column.isNotNull() & (whole["_corrupt"].isNotNull() | whole["v"].isNull() | ~column.rlike(opens))
    return F.struct(F.when(~bad, whole["v"]).alias("value"), F.when(bad, "not_decodable").alias("error"))
