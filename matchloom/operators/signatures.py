"""Signatures of what matching reads, kept as a tree of hashes (V1, V2, V4, V8).

An owner's inputs are lines of JSON, one for each row that tells about it, with all
columns of that row; its hash is the SHA-256 of the sorted lines.  Hashes of
candidates meet in buckets, and buckets in organisations, by sums: a node holds how
many hashes it has and four sums of 60 bits of each.  Sums need no order, gather
nothing, and change by what comes and goes, so a stored tree is brought up to date
from changed candidates alone, and two trees are compared by reading the leaves of
those buckets whose hashes differ.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of an organisation; also the folders of a stored tree.
BUCKETS = 256
_SUMS = ("s1", "s2", "s3", "s4")


def _line(kind: str, columns: Iterable[str]) -> Column:
    return F.concat(F.lit(f"{kind} "), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def signed(owners: DataFrame, key: str, own: list[str], keep: list[str], parts: dict[str, DataFrame]) -> DataFrame:
    """key, ``keep`` and hash of each owner over its ``own`` columns and all columns of its rows in each part.

    Owners without rows in a part have a hash too; rows of a part without an owner
    count for none.  One shuffle; nulls are told apart from empty texts.
    """
    kept = [F.col(c) for c in keep]
    lines = owners.select(key, *kept, F.lit(True).alias("_owner"), _line("own", own).alias("_line"))
    for kind, df in parts.items():
        absent = [F.lit(None).cast(owners.schema[c].dataType).alias(c) for c in keep]
        lines = lines.unionByName(df.select(key, *absent, F.lit(False).alias("_owner"), _line(kind, [c for c in df.columns if c != key]).alias("_line")))
    one = lines.groupBy(key).agg(*[F.max(c).alias(c) for c in keep], F.bool_or("_owner").alias("_owner"), F.array_sort(F.collect_list("_line")).alias("_lines"))
    return one.filter("_owner").select(key, *keep, F.sha2(F.array_join("_lines", "\n").cast("binary"), 256).alias("hash"))


def requirements_signature(requirements: DataFrame, requirement_skill: DataFrame, rules: DataFrame) -> DataFrame:
    """V1: requirements_id and signature of every requirement, bare ones too, over all columns of its skills and rules.

    ``requirements`` may have version and schema_version; other columns of it don't count.
    """
    own = [c for c in ("requirements_id", "version", "schema_version") if c in requirements.columns]
    return signed(requirements, "requirements_id", own, [], {"rule": rules, "skill": requirement_skill}).withColumnRenamed("hash", "signature")


def candidate_hashes(candidates: DataFrame, skills: DataFrame, profiles: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """V2, leaves: org_id, candidate_id, hash of each active candidate over what filters, scores and evidence read.

    All columns of skills (label, evidence, years, source document and profile),
    of the confirmed profiles (one a candidate) and of the facts that these tell
    count; of the candidate itself only its place.  Contact data are left out.
    """
    parts = {"skill": skills, **({"profile": profiles} if profiles is not None else {}), **({"fact": facts} if facts is not None else {})}
    return signed(candidates.filter("status = 'active'"), "candidate_id", ["candidate_id", "location"], ["org_id"], parts).select("org_id", "candidate_id", "hash")


def _pieces(h: str = "hash") -> list[Column]:
    """Four sums of 60 bits each of a hash."""
    piece = lambda i: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return [F.sum(piece(i)).cast("decimal(38,0)").alias(s) for i, s in enumerate(_SUMS)]


def _node(*columns: str) -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]), 256)


def leaves(hashes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """hashes(org_id, candidate_id, hash) with their bucket."""
    return hashes.select("org_id", F.pmod("candidate_id", F.lit(buckets)).cast("int").alias("bucket"), "candidate_id", "hash")


def bucket_nodes(held: DataFrame) -> DataFrame:
    """org_id, bucket, n, the four sums and the bucket's hash."""
    return held.groupBy("org_id", "bucket").agg(F.count("*").alias("n"), *_pieces()).withColumn("hash", _node("n", *_SUMS))


def pool_signature(nodes: DataFrame) -> DataFrame:
    """V2, root: org_id and signature of each organisation over its bucket nodes."""
    return nodes.groupBy("org_id").agg(F.count("*").alias("n"), *_pieces()).select("org_id", _node("n", *_SUMS).alias("signature"))


def save_tree(hashes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Leaves in a folder for each bucket, and the bucket nodes."""
    leaves(hashes, buckets).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/leaves")
    spark = hashes.sparkSession
    bucket_nodes(spark.read.parquet(f"{path}/leaves")).write.parquet(f"{path}/buckets")


def read_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Leaves and bucket nodes of a stored tree."""
    return spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/buckets")


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """org_id, bucket of the nodes that differ or are on one side only."""
    a, b = before.select("org_id", "bucket", F.col("hash").alias("_a")), after.select("org_id", "bucket", F.col("hash").alias("_b"))
    return a.join(b, ["org_id", "bucket"], "full").filter("not (_a <=> _b)").select("org_id", "bucket")


def tree_changes(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """V4: org_id, candidate_id, change (added, removed, changed) between two trees, each (leaves, bucket nodes).

    Only leaves of buckets whose hashes differ are read: their numbers, at most as
    many as there are buckets, become a filter on the folders.  A candidate that
    moves to another organisation is removed from one and added to the other.
    """
    nodes = changed_buckets(before[1], after[1])
    numbers = sorted(r.bucket for r in nodes.select("bucket").distinct().collect())
    some = [t.filter(F.col("bucket").isin(numbers)).hint("merge").join(nodes.hint("merge"), ["org_id", "bucket"], "left_semi") for t in (before[0], after[0])]
    return changed(*some, ["org_id", "candidate_id"], "hash")


def update_nodes(nodes: DataFrame, changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Bucket nodes after changes(org_id, candidate_id, before, after) of hashes, null where there is none; no leaf is read."""
    at = F.pmod("candidate_id", F.lit(buckets)).cast("int").alias("bucket")
    gone = changes.filter("before is not null").select("org_id", at, F.lit(-1).alias("sign"), F.col("before").alias("hash"))
    come = changes.filter("after is not null").select("org_id", at, F.lit(1).alias("sign"), F.col("after").alias("hash"))
    piece = lambda i: F.conv(F.substring("hash", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") * F.col("sign")
    delta = gone.unionByName(come).groupBy("org_id", "bucket").agg(F.sum("sign").alias("n"), *[F.sum(piece(i)).cast("decimal(38,0)").alias(s) for i, s in enumerate(_SUMS)])
    both = nodes.select("org_id", "bucket", "n", *_SUMS).unionByName(delta).groupBy("org_id", "bucket").agg(F.sum("n").alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in _SUMS])
    return both.filter("n > 0").withColumn("hash", _node("n", *_SUMS))


def changed(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """V4, V8: rows added, removed or changed between two snapshots of (key, value)."""
    a, b = before.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), after.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    rows = a.join(b, key, "full")
    kind = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return rows.select(*key, kind.alias("change")).filter("change is not null")
