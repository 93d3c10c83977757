"""Ranking quality (L), expected rankings (J13, J14) and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import canonical_json, gain


def at_k(ranked: DataFrame, judgments: DataFrame, k: int = 5, relevant: int = 2) -> DataFrame:
    """L1, L2: nDCG@k and precision@k by query, four digits; queries with fewer than k ranked rows give null.

    ranked(query_id, doc_id, rnk), judgments(query_id, doc_id, grade); a row
    without a judgment has grade zero.
    """
    top = ranked.filter(F.col("rnk") <= k).join(judgments, ["query_id", "doc_id"], "left").fillna({"grade": 0})
    got = top.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rnk"))).alias("dcg"), F.count("*").alias("n"), F.count_if(F.col("grade") >= relevant).alias("hits"))
    best = judgments.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).filter(F.col("i") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("i"))).alias("ideal"))
    enough = F.col("n") >= k
    ndcg = F.when(enough, F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))
    rows = got.join(ideal, "query_id", "left")
    return rows.select("query_id", F.round(ndcg, 4).cast("decimal(6,4)").alias("ndcg"), F.round(F.when(enough, F.col("hits") / k), 4).cast("decimal(6,4)").alias("precision"))


def overlap_at_k(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Share of the expected first k that are among the first k."""
    want = expected.filter(F.col("rnk") <= k).select("query_id", "doc_id")
    hits = ranked.filter(F.col("rnk") <= k).select("query_id", "doc_id").distinct().join(want, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hits"))
    rows = want.select("query_id").distinct().join(hits, "query_id", "left").fillna(0)
    return rows.select("query_id", F.round(F.col("hits") / k, 4).cast("decimal(6,4)").alias("overlap"))


def macro(values: DataFrame, *columns: str) -> DataFrame:
    """L4: mean of already rounded values, four digits."""
    return values.agg(*[F.round(F.avg(c), 4).cast("decimal(6,4)").alias(c) for c in columns], F.count("*").alias("queries"))


def coverage_gate(entries: DataFrame, assessments: DataFrame) -> DataFrame:
    """entries(query_id, entry_id, rank, current_profile) ordered by assessed score, if every entry of the query has a current assessment; else unavailable and no order."""
    rows = entries.join(assessments, "entry_id", "left").withColumn("_ok", F.coalesce(F.col("profile_id") == F.col("current_profile"), F.lit(False)))
    whole = rows.groupBy("query_id").agg((F.count_if("_ok") == F.count("*")).alias("complete"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "entry_id")
    rows = rows.join(whole, "query_id").withColumn("n", F.row_number().over(order))
    return rows.select("query_id", "entry_id", F.when(F.col("complete"), F.col("n")).alias("rnk"), F.when(F.col("complete"), "available").otherwise("unavailable").alias("gate"))


def binding_issues(codes: DataFrame, bound: DataFrame) -> DataFrame:
    """codes(code) against bound(code): missing, unexpected, repeated."""
    n = bound.groupBy("code").agg(F.count("*").alias("n"))
    rows = codes.select("code").distinct().withColumn("_want", F.lit(True)).join(n, "code", "full")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return rows.select("code", issue.alias("issue")).filter("issue is not null")


def ranking_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Ranks at which code or score differ from the expected list."""
    a, e = actual.select("query_id", "rnk", F.struct("code", "score").alias("got")), expected.select("query_id", "rnk", F.struct("code", "score").alias("wanted"))
    return a.join(e, ["query_id", "rnk"], "full").filter(~F.col("got").eqNullSafe(F.col("wanted")))


def measurement_gate(queries: DataFrame, runs: DataFrame, pool: DataFrame) -> DataFrame:
    """The first reason against measuring each query, else ok.

    queries(query_id, requirements_id; null without current requirements),
    runs(requirements_id, run_id, is_stale, candidates): the latest run counts,
    pool(query_id, candidates): how many candidates a complete run covers.
    """
    newest = runs.withColumn("_n", F.row_number().over(Window.partitionBy("requirements_id").orderBy(F.desc("run_id")))).filter("_n = 1").drop("_n")
    rows = queries.join(newest.withColumnRenamed("candidates", "covered"), "requirements_id", "left").join(pool, "query_id", "left")
    reason = (
        F.when(F.col("requirements_id").isNull(), "no_current_requirements").when(F.col("run_id").isNull(), "no_run").when(F.col("is_stale"), "run_is_stale")
        .when(F.coalesce("covered", F.lit(0)) != F.coalesce("candidates", F.lit(0)), "pool_incomplete").otherwise("ok")
    )
    return rows.select("query_id", reason.alias("measurement_gate"))


def dataset_identity(dataset: DataFrame) -> DataFrame:
    """A hash of each dataset row's canonical JSON, names sorted at every level."""
    return dataset.select("dataset_id", F.sha2(canonical_json(dataset), 256).alias("identity"))
