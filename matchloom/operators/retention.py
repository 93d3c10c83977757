"""Retention, minimisation and audit history (K, O5, J4, J5, D2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import due


def visible(rows: DataFrame, members: DataFrame, organizations: DataFrame, user_id: int, admin: bool = False) -> DataFrame:
    """Rows of active organisations in which the user is an active member (or admin)."""
    mine = members.filter((F.col("user_id") == user_id) & F.col("is_active"))
    mine = mine.filter("is_admin") if admin else mine
    live = mine.join(organizations.filter("is_active"), "org_id", "left_semi").select("org_id")
    return rows.join(live, "org_id", "left_semi")


def overdue(candidates: DataFrame, sources: DataFrame, documents: DataFrame, as_of: str) -> DataFrame:
    """K1: kind, candidate_id, retention_until of candidates (active or inactive), sources (not deleted) and live documents due by as_of."""
    day = F.lit(as_of).cast("date")
    state = candidates.select("candidate_id", "status")
    live = candidates.filter("status in ('active', 'inactive')")
    src = sources.join(state.filter("status <> 'deleted'"), "candidate_id", "left_semi")
    doc = documents.filter("not is_deleted").join(state.filter("status in ('active', 'inactive', 'deletion_requested')"), "candidate_id", "left_semi")
    parts = [df.filter(due(F.col("retention_until"), day)).select(F.lit(kind).alias("kind"), "candidate_id", "retention_until") for kind, df in (("candidate", live), ("source", src), ("document", doc))]
    return reduce(DataFrame.unionByName, parts)


def without_retention(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """K2: for each organisation, rows without a date: candidates and sources; zero counts are kept."""
    home = candidates.select("candidate_id", "org_id", "status")
    a = candidates.groupBy("org_id").agg(F.count_if(F.col("status").isin("active", "inactive") & F.col("retention_until").isNull()).alias("candidates_without"))
    b = sources.join(home.filter("status <> 'deleted'"), "candidate_id").groupBy("org_id").agg(F.count_if(F.col("retention_until").isNull()).alias("sources_without"))
    return a.join(b, "org_id", "left").fillna({"sources_without": 0})


def pending_deletions(candidates: DataFrame) -> DataFrame:
    """K3."""
    return candidates.filter("status = 'deletion_requested'")


def identity_issues(candidates: DataFrame) -> DataFrame:
    """K4: deleted candidates that keep more than a tombstone: name, contact data, place or date."""
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("email", "phone", "location", "retention_until", "status_before_deletion_request") if c in candidates.columns]
    name = F.col("full_name") != F.concat(F.lit("Deleted candidate #"), F.col("candidate_id").cast("string"))
    bad = candidates.filter("status = 'deleted'").filter(reduce(lambda a, b: a | b, kept, F.coalesce(name, F.lit(True))))
    return bad.select(F.lit("deleted_candidate_retains_identity").alias("code"), "candidate_id")


def leftovers(candidates: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Deleted candidates that children tables still refer to, once for each kind."""
    gone = candidates.filter("status = 'deleted'").select("candidate_id")
    parts = [gone.join(df.select("candidate_id"), "candidate_id", "left_semi").select(F.lit(f"deleted_candidate_retains_{kind}").alias("code"), "candidate_id") for kind, df in children.items()]
    return reduce(DataFrame.unionByName, parts)


def retention_run(candidates: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K6: counts by organisation (zero kept), the new snapshot, and an event for each candidate flagged.

    Active and inactive candidates that are due become deletion requests; nothing
    is purged, and running it again flags nobody.
    """
    hit = F.col("status").isin("active", "inactive") & due(F.col("retention_until"), F.lit(as_of).cast("date"))
    marked = candidates.withColumn("_due", F.coalesce(hit, F.lit(False)))
    counts = marked.groupBy("org_id").agg(F.count_if("_due").alias("flagged"))
    events = marked.filter("_due").select("org_id", "candidate_id", F.lit("deletion_requested").alias("action"), F.col("status").alias("status_before"))
    snapshot = marked.withColumn("status_before_deletion_request", F.when(F.col("_due"), F.col("status")).otherwise(F.lit("")))
    return counts, snapshot.withColumn("status", F.when(F.col("_due"), "deletion_requested").otherwise(F.col("status"))).drop("_due"), events


def cancel_deletions(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """K7: requested deletions in ids(candidate_id) go back to the status before."""
    hit = candidates.join(ids.select("candidate_id").distinct().withColumn("_hit", F.lit(True)), "candidate_id", "left")
    back = F.col("_hit").isNotNull() & (F.col("status") == "deletion_requested")
    before = F.coalesce(F.nullif("status_before_deletion_request", F.lit("")), F.lit("active"))
    return hit.withColumns({"status": F.when(back, before).otherwise(F.col("status")), "status_before_deletion_request": F.when(back, "").otherwise(F.col("status_before_deletion_request"))}).drop("_hit")


def purge(candidates: DataFrame, ids: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """K7: tombstones for requested deletions in ids, and the children tables without their rows."""
    requested = candidates.filter("status = 'deletion_requested'").join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi").select("candidate_id")
    hit = candidates.join(requested.withColumn("_hit", F.lit(True)), "candidate_id", "left")
    gone = F.col("_hit").isNotNull()
    blank = {c: F.when(gone, "").otherwise(F.col(c)) for c in ("email", "phone", "location", "status_before_deletion_request") if c in candidates.columns}
    tomb = hit.withColumns({
        **blank, "full_name": F.when(gone, F.concat(F.lit("Deleted candidate #"), F.col("candidate_id").cast("string"))).otherwise(F.col("full_name")),
        "retention_until": F.when(~gone, F.col("retention_until")), "status": F.when(gone, "deleted").otherwise(F.col("status")),
    }).drop("_hit")
    return tomb, {k: df.join(requested, "candidate_id", "left_anti") for k, df in children.items()}


def history(tables: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """The newest rows of each kind and organisation from tables of (org_id, object_id, at); the limit is held to 1..100."""
    n = max(1, min(100, limit))
    rows = reduce(DataFrame.unionByName, [df.select("org_id", F.lit(k).alias("kind"), "object_id", "at") for k, df in tables.items()])
    newest = Window.partitionBy("org_id", "kind").orderBy(F.desc("at"), F.desc("object_id"))
    return rows.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= n)
