"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return join_hot(both.filter("b > a"), low, "a", 8).select(F.col("low").alias("a"), "b").filter("a < b").distinct()  # a hub has most of the edges


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    moved = join_hot(edges, low, "b", 8).select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("low").alias("a"), "b")).filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges(a, b); only nodes with an edge appear.

    Each round is two shuffles and a checkpoint; the edges end as stars around
    the smallest node, after a number of rounds that grows with the logarithm
    of a component's size.  Self links and rows with nulls are ignored.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def join_hot(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """left joined with right, where one key may hold most rows of left: they are dealt under salts, and each row of right goes to all."""
    spread = left.withColumn("_salt_", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.hint("merge").join(copies.hint("merge"), [key, "_salt_"]).drop("_salt_")


def one_of_each(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of rows(doc_id, _key, ...) one row for each component of roots(node, root) over _key: the smallest doc_id, null last.

    Rows are told apart by all their columns, not by doc_id.
    """
    rows = rows.withColumn("_row", F.xxhash64(*[f"`{c}`" for c in rows.columns]))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "_key")).alias("best")
    low = cut(rows.groupBy("_key").agg(best))
    low = low.hint("merge").join(roots.withColumnRenamed("node", "_key").hint("merge"), "_key", "left")
    kept = low.groupBy(F.coalesce("root", "_key").alias("root")).agg(F.min("best").alias("best")).select("best._key", "best._row")
    return rows.hint("merge").join(kept.hint("merge"), ["_key", "_row"], "left_semi").dropDuplicates(["_key", "_row"])
