"""Versions, currency and eligibility (W, V3, V5-V12, A14, J9, J12); signatures are in signatures.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def next_version(versions: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The version that comes next for each parent; one where there is none yet."""
    top = versions.groupBy(key).agg(F.max("version").alias("top"))
    return parents.select(key).distinct().join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)) + 1).alias("next_version"))


REASONS = ("scoring_algorithm_changed", "input_snapshot_unavailable", "vacancy_requirements_changed", "candidate_inputs_changed", "vacancy_deleted")


def staleness(runs: DataFrame, current: DataFrame, pools: DataFrame, algorithm: str, snapshot: str) -> DataFrame:
    """V3: ordered reason codes for each run.

    runs(run_id, requirements_id, org_id, algorithm_version, snapshot_version, requirements_signature, pool_signature, vacancy_deleted),
    current(requirements_id, signature) for those that are current, pools(org_id, signature).
    """
    rows = runs.join(current.select("requirements_id", F.col("signature").alias("_r")), "requirements_id", "left").join(pools.select("org_id", F.col("signature").alias("_p")), "org_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = (F.coalesce("snapshot_version", F.lit("")) != snapshot) | blank("requirements_signature") | blank("pool_signature")
    conditions = (
        F.coalesce("algorithm_version", F.lit("")) != algorithm, missing, ~missing & ~F.col("requirements_signature").eqNullSafe(F.col("_r")),
        ~missing & ~F.col("pool_signature").eqNullSafe(F.col("_p")), F.coalesce("vacancy_deleted", F.lit(False)),
    )
    codes = F.array_compact(F.array(*[F.when(c, code) for code, c in zip(REASONS, conditions, strict=True)]))
    return rows.withColumn("reasons", codes).withColumn("is_stale", F.size("reasons") > 0).drop("_r", "_p")


def first_failing(rules: list[tuple]) -> Column:
    """The code of the first condition that holds, else 'ok'."""
    out = F
    for i, (condition, code) in enumerate(rules):
        out = out.when(condition, code) if i else F.when(condition, code)
    return out.otherwise("ok")


def decision_eligibility(assessments: DataFrame) -> DataFrame:
    """V5 over assessments(candidate_status, vacancy_deleted, is_latest, profile_id, current_profile_id, is_stale)."""
    return assessments.withColumn("decision_gate", first_failing([
        (F.col("candidate_status") != "active", "candidate_inactive"), (F.col("vacancy_deleted"), "vacancy_deleted"), (~F.col("is_latest"), "not_latest_assessment"),
        (~F.col("current_profile_id").eqNullSafe(F.col("profile_id")), "profile_changed"), (F.col("is_stale"), "inputs_changed"),
    ]))


def outreach_eligibility(rows: DataFrame) -> DataFrame:
    """V6 and V7 over decision_eligibility rows with is_latest_decision, decision, is_latest_draft, approved, contact_gate."""
    draft = first_failing([
        (~F.col("is_latest_decision"), "not_latest_decision"), (F.col("decision") != "approved", "not_approved"), (F.col("decision_gate") != "ok", "decision_outdated"),
    ])
    rows = rows.withColumn("draft_gate", draft)
    approve = first_failing([
        (~F.col("is_latest_draft"), "not_latest_draft"), (F.col("draft_gate") != "ok", "draft_outdated"), (F.col("approved"), "already_approved"), (F.col("contact_gate") != "ok", "contact_blocked"),
    ])
    act = first_failing([
        (~F.col("is_latest_draft"), "not_latest_draft"), (~F.col("approved"), "not_approved"), (F.col("draft_gate") != "ok", "draft_outdated"), (F.col("contact_gate") != "ok", "contact_blocked"),
    ])
    return rows.withColumn("approve_gate", approve).withColumn("action_gate", act)


def reuse(targets: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Skipped without a profile, reused where a result with the same key is there, else created."""
    had = results.select(*key).distinct().withColumn("_had", F.lit(True))
    outcome = F.when(F.col("profile_id").isNull(), "skipped").when(F.col("_had"), "reused").otherwise("created")
    return targets.join(had, key, "left").withColumn("outcome", outcome).drop("_had")


def pending_work(documents: DataFrame, done: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """The newest document of each candidate, if it has no result and isn't queued."""
    newest = latest(documents, ["candidate_id"], [F.desc("document_id")])
    rest = newest.join(done.select("document_id").distinct(), "document_id", "left_anti")
    return rest.join(queued.select("document_id").distinct(), "document_id", "left_anti") if queued is not None else rest


def retry(tasks: DataFrame) -> DataFrame:
    """Skipped and failed tasks, queued again."""
    return tasks.filter("status in ('skipped', 'failed')").withColumn("status", F.lit("queued"))


def batch_key(members: DataFrame, batch: list[str], schema: str) -> DataFrame:
    """An idempotency key of each batch over its sorted (id, hash) members."""
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "id", "hash")))
    return members.groupBy(*batch).agg(F.sha2(F.concat_ws("|", F.lit(schema), *[F.col(b).cast("string") for b in batch], F.concat_ws(",", listed)), 256).alias("batch_key"))


def carry_forward(versions: DataFrame, key: str, columns: list[str], children: dict[str, DataFrame] | None = None, version_id: str = "requirements_id"):
    """V9: a draft of the next version with the columns of the latest confirmed one; none where any draft is open.

    With ``children`` (each with ``version_id``, the id of the version that it belongs
    to) the result is a pair: the drafts, with the id that they copy as ``copied_from``,
    and for each name the children of those versions with key and version of the new draft.
    """
    held = [version_id] if children is not None else []
    current = latest(versions.filter("status = 'confirmed'"), [key], [F.desc("version"), *columns, *held]).select(key, *columns, *held)
    open_ = versions.filter("status = 'draft'").select(key).distinct()
    after = next_version(versions, versions, key)
    drafts = current.join(open_, key, "left_anti").join(after, key).withColumnRenamed("next_version", "version").withColumn("status", F.lit("draft"))
    if children is None:
        return drafts
    drafts = drafts.withColumnRenamed(version_id, "copied_from")
    new = drafts.select(key, "version", F.col("copied_from").alias(version_id))
    return drafts, {name: df.join(new, version_id).drop(version_id) for name, df in children.items()}
