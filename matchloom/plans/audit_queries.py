"""Queries of the usage, version, retention and review areas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir
from ..operators import retention as K
from ..operators import review as R
from ..operators import signatures as G
from ..operators import usage as A
from ..operators import versions as V
from .fixtures import oracle, view

NOW, AS_OF = "2024-01-31 00:00:00", "2024-06-30"


def usage_overall(spark, sf_dir):
    return A.overall(view(spark, sf_dir, "fx_usage"))


def usage_breakdown(spark, sf_dir):
    return A.by_dimension(view(spark, sf_dir, "fx_usage"))


def usage_period(spark, sf_dir):
    return A.overall(A.within(view(spark, sf_dir, "fx_usage"), NOW, "30", "match_assessment"))


def usage_failures(spark, sf_dir):
    return A.failures(view(spark, sf_dir, "fx_usage"))


def usage_daily90(spark, sf_dir):
    return A.daily(view(spark, sf_dir, "fx_usage"))


def stale_pending(spark, sf_dir):
    return A.stale_pending(view(spark, sf_dir, "fx_usage"), NOW)


def usage_completion(spark, sf_dir):
    u = view(spark, sf_dir, "fx_usage")
    starts = u.select("event_id", "org_id", F.lit("pending").alias("status"), "failure_stage", "failure_code")
    ends = u.filter("status <> 'pending'").select(
        "event_id", (F.col("status") == "succeeded").alias("ok"), (F.col("failure_stage") == "gateway").alias("from_gateway"), "failure_code"
    )
    return A.completions(starts, ends).groupBy("org_id", "status", "failure_stage", "failure_code").agg(F.count("*").alias("n"))


def latest_version(spark, sf_dir):
    return V.latest(view(spark, sf_dir, "fx_assessment"), ["entry_id"], [F.desc("version")])


def next_version(spark, sf_dir):
    a = view(spark, sf_dir, "fx_assessment")
    return V.next_version(a, a.select("entry_id").unionByName(view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"))), "entry_id")


def review_queue(spark, sf_dir):
    return R.queue(view(spark, sf_dir, "fx_review"))


def review_page(spark, sf_dir):
    return R.page(R.scope(review_queue(spark, sf_dir), "focus"), 2).select("entry_id", "version", "category", "position")


def review_counts(spark, sf_dir):
    return R.queue_counts(review_queue(spark, sf_dir))


def contact_permission(spark, sf_dir):
    return R.contact_gate(view(spark, sf_dir, "fx_candidate"), view(spark, sf_dir, "fx_source"))


def status_transitions(spark, sf_dir):
    return R.transition_issues(view(spark, sf_dir, "fx_transition"), view(spark, sf_dir, "fx_vacancy")).select("vacancy_id", "step", "reason")


def profile_gate(spark, sf_dir):
    return R.profile_gate(view(spark, sf_dir, "fx_document")).groupBy("org_id", "profile_gate").agg(F.count("*").alias("n"))


def job_rollup(spark, sf_dir):
    return R.job_rollup(view(spark, sf_dir, "fx_task"))


def retry_selection(spark, sf_dir):
    return V.retry(view(spark, sf_dir, "fx_task"))


def dashboard_counts(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    clients = v("fx_member").select("org_id", "is_active")
    return R.dashboard(v("fx_organization"), v("fx_candidate"), v("fx_vacancy"), clients)


def retention_due(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    docs = v("fx_document").select("candidate_id", F.lit("2024-05-01").cast("date").alias("retention_until"), "is_deleted").filter("candidate_id > 0").distinct()
    return K.overdue(v("fx_candidate"), v("fx_source"), docs, AS_OF)


def retention_missing(spark, sf_dir):
    return K.without_retention(view(spark, sf_dir, "fx_candidate"), view(spark, sf_dir, "fx_source"))


def retention_dry_run(spark, sf_dir):
    return K.retention_run(view(spark, sf_dir, "fx_candidate"), AS_OF)[0]


def retention_snapshot(spark, sf_dir):
    return K.retention_run(view(spark, sf_dir, "fx_candidate"), AS_OF)[1].select("candidate_id", "status", "status_before_deletion_request")


def pending_deletions(spark, sf_dir):
    return K.pending_deletions(view(spark, sf_dir, "fx_candidate")).select("candidate_id", "org_id")


def minimisation_issues(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    kids = {"source": v("fx_source"), "skill": v("fx_candidate_skill")}
    return K.identity_issues(v("fx_candidate")).unionByName(K.leftovers(v("fx_candidate"), kids))


def purge_sources(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return K.purge(v("fx_candidate"), v("fx_candidate").filter("candidate_id % 40 = 1"), {"source": v("fx_source")})[1]["source"].select("candidate_id")


def audit_history(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    usage = v("fx_usage").select("org_id", F.col("event_id").alias("object_id"), F.col("started_at").alias("at"))
    orders = v("orders").select((F.col("o_custkey") % 5).cast("int").alias("org_id"), F.col("o_orderkey").alias("object_id"), F.col("o_orderdate").alias("at"))
    return K.history({"usage": usage, "vacancy": orders}).select("org_id", "kind", "object_id", "position")


def visible_candidates(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return K.visible(v("fx_candidate").select("candidate_id", "org_id"), v("fx_member"), v("fx_organization"), 4, admin=True)


def _before(spark, sf_dir):
    """An earlier state of the pool: some candidates elsewhere, some not yet there, some that have left since."""
    c = view(spark, sf_dir, "fx_candidate")
    c = c.filter("candidate_id % 31 <> 5").withColumn("location", F.when(F.col("candidate_id") % 29 == 0, "ELSEWHERE").otherwise(F.col("location")))
    return c.withColumn("status", F.when(F.col("candidate_id") % 37 == 0, "active").otherwise(F.col("status")))


def changed_candidates(spark, sf_dir):
    """Two stored trees: the earlier one has some candidates elsewhere, some not yet, and other evidence of the skills of some."""
    v = lambda n: view(spark, sf_dir, n)
    skills, folder = v("fx_candidate_skill_full"), f"{checkpoint_dir(spark)}/pool-{uuid.uuid4().hex}"
    earlier = skills.withColumn("evidence", F.when(F.col("candidate_id") % 41 == 0, "").otherwise(F.col("evidence")))
    G.save_tree(G.candidate_hashes(_before(spark, sf_dir), earlier), f"{folder}/before")
    G.save_tree(G.candidate_hashes(v("fx_candidate"), skills), f"{folder}/after")
    return G.tree_changes(G.read_tree(spark, f"{folder}/before"), G.read_tree(spark, f"{folder}/after"))


def staleness(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    skills, req = v("fx_candidate_skill_full"), v("fx_requirement_version")
    now_sig = G.requirements_signature(req, v("fx_requirement_skill"), v("fx_rule"))
    then_sig = G.requirements_signature(req, v("fx_requirement_skill"), v("fx_rule").filter("requirements_id % 15 <> 0"))
    pools = _pools(G.candidate_hashes(v("fx_candidate"), skills))
    old = _pools(G.candidate_hashes(v("fx_candidate").filter("not (org_id = 1 and candidate_id % 31 = 5)"), skills))
    r = F.col("requirements_id")
    runs = v("fx_requirements").join(then_sig, "requirements_id").join(old.withColumnRenamed("signature", "pool_signature"), "org_id").select(
        r.alias("run_id"), "requirements_id", "org_id", F.when(r % 8 == 0, "v0").otherwise("v1").alias("algorithm_version"), F.when(r % 9 == 0, "").otherwise("s1").alias("snapshot_version"),
        F.col("signature").alias("requirements_signature"), "pool_signature", (r % 10 == 0).alias("vacancy_deleted"),
    )
    return V.staleness(runs, now_sig, pools, "v1", "s1").select("run_id", "is_stale", F.concat_ws(",", "reasons").alias("reasons"))


def _pools(hashes):
    return G.pool_signature(G.bucket_nodes(G.leaves(hashes)))


def pool_signatures(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return _pools(G.candidate_hashes(v("fx_candidate"), v("fx_candidate_skill_full"), v("fx_profile"), v("fx_profile_fact")))


def requirement_signatures(spark, sf_dir):
    """Every requirement, those without skills or rules too."""
    v = lambda n: view(spark, sf_dir, n)
    return G.requirements_signature(v("fx_requirement_version"), v("fx_requirement_skill").filter("requirements_id % 6 <> 1"), v("fx_rule"))


def pending_profiles(spark, sf_dir):
    d = view(spark, sf_dir, "fx_document").filter("document_type = 'cv' and not is_deleted")
    return V.pending_work(d, d.filter("document_id % 3 = 0")).select("candidate_id", "document_id")


def reuse_results(spark, sf_dir):
    t = view(spark, sf_dir, "fx_document").select("document_id", "candidate_id", F.when(F.col("document_id") % 7 != 0, F.col("candidate_id")).alias("profile_id"))
    return V.reuse(t, t.filter("document_id % 5 = 0"), ["candidate_id", "document_id"]).select("document_id", "outcome")


def decision_eligibility(spark, sf_dir):
    a, c = view(spark, sf_dir, "fx_review"), view(spark, sf_dir, "fx_candidate")
    top = a.groupBy("entry_id").agg(F.max("version").alias("top"))
    rows = a.join(top, "entry_id").join(c.select(F.col("candidate_id").alias("entry_id"), F.col("status").alias("candidate_status")), "entry_id")
    e = F.col("entry_id")
    rows = rows.select("entry_id", "version", "candidate_status", (e % 23 == 0).alias("vacancy_deleted"), (F.col("version") == F.col("top")).alias("is_latest"), e.alias("profile_id"), F.when(e % 12 != 0, e).alias("current_profile_id"), F.col("changed").alias("is_stale"))
    return V.decision_eligibility(rows).select("entry_id", "version", "decision_gate")


_M = """count(*) AS attempts, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending,
  CASE WHEN count(*) FILTER (status IN ('succeeded', 'failed')) > 0 THEN
    CAST(floor(count(*) FILTER (status = 'succeeded') * 1000.0 / count(*) FILTER (status IN ('succeeded', 'failed')) + 0.5) / 10 AS DECIMAL(5,1)) END AS success_rate,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(total_tokens) AS total_tokens_known, count(*) - count(total_tokens) AS total_tokens_missing,
  CAST(floor(CAST(sum(duration_ms) AS BIGINT) * 1000.0 / count(duration_ms) + 0.5) / 1000 AS DECIMAL(16,3)) AS average_duration_ms, count(duration_ms) AS duration_known, count(*) - count(duration_ms) AS duration_missing,
  CAST(coalesce(sum(CASE WHEN provider_request_id <> '' THEN retries_used END), 0) AS BIGINT) AS retries_used,
  count(*) FILTER (provider_request_id <> '' AND retries_used > 0) AS retried_attempts, count(*) FILTER (provider_request_id <> '') AS retries_known,
  count(*) FILTER (provider_request_id = '') AS retries_missing, count(*) FILTER (model <> '') AS model_known, count(*) FILTER (model = '') AS model_missing"""

_SUMS_SQL = "count(*) AS n, " + ", ".join(f"sum(('0x' || substr(hash, {1 + 15 * i}, 15))::BIGINT) AS s{i + 1}" for i in range(4))
_BEFORE = """
before AS (SELECT org_id, candidate_id, CASE WHEN candidate_id % 29 = 0 THEN 'ELSEWHERE' ELSE location END AS location FROM {fx_candidate}
           WHERE candidate_id % 31 <> 5 AND (candidate_id % 37 = 0 OR status = 'active')),
after AS (SELECT org_id, candidate_id, location FROM {fx_candidate} WHERE status = 'active')"""


def sql() -> dict[str, str]:
    return {
        "usage_overall": oracle("SELECT org_id, " + _M + " FROM {fx_usage} GROUP BY 1"),
        "usage_period": oracle("SELECT org_id, " + _M + " FROM {fx_usage} WHERE started_at >= TIMESTAMP '2024-01-01 00:00:00' AND workflow = 'match_assessment' GROUP BY 1"),
        "usage_breakdown": oracle(
            "WITH b AS (SELECT org_id, 'all' AS dimension, '' AS value, " + _M + " FROM {fx_usage} GROUP BY 1 UNION ALL SELECT org_id, 'workflow', workflow, " + _M
            + " FROM {fx_usage} GROUP BY 1, 3 UNION ALL SELECT org_id, 'model', model, " + _M + " FROM {fx_usage} WHERE model <> '' GROUP BY 1, 3),"
            " l AS (SELECT *, CASE WHEN dimension = 'workflow' THEN concat(upper(left(value, 1)), replace(substr(value, 2), '_', ' ')) ELSE value END AS label FROM b)"
            " SELECT *, CAST(row_number() OVER (PARTITION BY org_id, dimension ORDER BY lower(label), value) AS INT) AS position FROM l"
        ),
        "usage_failures": oracle("""
            SELECT org_id, failure_stage, failure_code, count(*) AS n, CASE failure_stage WHEN 'gateway' THEN 'Gateway' WHEN 'application' THEN 'Application validation' ELSE 'Recorded failure' END AS stage_label,
              CASE failure_code WHEN 'ai_request_failed' THEN 'AI request failed' WHEN 'ai_service_unavailable' THEN 'AI service unavailable' ELSE 'Other recorded failure' END AS label FROM {fx_usage} WHERE status = 'failed' GROUP BY 1, 2, 3"""),
        "usage_daily90": oracle("""
            SELECT * FROM (SELECT org_id, CAST(started_at AS DATE) AS day, count(*) AS attempts, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
              CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(total_tokens) AS tokens_known FROM {fx_usage} GROUP BY 1, 2)
            QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY day DESC) <= 90"""),
        "stale_pending": oracle("SELECT org_id, count(*) FILTER (status = 'pending' AND started_at < TIMESTAMP '2024-01-30 23:45:00') AS stale_pending FROM {fx_usage} GROUP BY 1"),
        "usage_completion": oracle("""
            SELECT org_id, status, CASE WHEN status <> 'failed' THEN '' WHEN failure_stage = 'gateway' THEN 'gateway' ELSE 'application' END AS failure_stage,
              CASE WHEN status <> 'failed' THEN '' WHEN failure_stage = 'gateway' THEN CASE WHEN failure_code LIKE 'ai_%' THEN failure_code ELSE 'ai_request_failed' END ELSE 'ai_application_validation' END AS failure_code, count(*) AS n FROM {fx_usage} GROUP BY 1, 2, 3, 4"""),
        "latest_version": oracle("SELECT entry_id, version, score FROM {fx_assessment} a WHERE version = (SELECT max(version) FROM {fx_assessment} b WHERE b.entry_id = a.entry_id)"),
        "next_version": oracle("SELECT p.entry_id, coalesce(max(version), 0) + 1 AS next_version FROM (SELECT entry_id FROM {fx_assessment} UNION SELECT o_orderkey FROM {orders}) p LEFT JOIN {fx_assessment} a ON a.entry_id = p.entry_id GROUP BY 1"),
        "review_queue": oracle("SELECT *, " + _CATEGORY + " AS category FROM {fx_review} QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1"),
        "review_page": oracle(
            "WITH q AS (SELECT *, " + _CATEGORY + " AS category FROM {fx_review} QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1) "
            "SELECT entry_id, version, category, row_number() OVER (ORDER BY category, gaps DESC, uncertain DESC, ambiguities DESC, version DESC, entry_id) AS position FROM q WHERE category < 4 QUALIFY position BETWEEN 26 AND 50"
        ),
        "review_counts": oracle(
            "WITH q AS (SELECT *, " + _CATEGORY + " AS category FROM {fx_review} QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version DESC) = 1) "
            "SELECT count(*) AS total, count(*) FILTER (category < 4) AS focus, count(*) FILTER (changed) AS changed, count(*) FILTER (category = 4) AS routine, count(*) FILTER (changed OR decision = 'pending') AS pending, "
            "count(*) FILTER (NOT changed AND decision = 'approved') AS approved, count(*) FILTER (NOT changed AND decision = 'rejected') AS rejected, count(*) FILTER (NOT changed AND decision = 'revisit') AS revisit FROM q"
        ),
        "contact_permission": oracle("""
            SELECT c.candidate_id, CASE WHEN max(s.candidate_id) IS NULL THEN 'no_provenance' WHEN bool_or(consent_status = 'withdrawn') THEN 'consent_withdrawn'
              WHEN bool_or(contact_permission = 'withdrawn') THEN 'permission_withdrawn' WHEN bool_or(contact_permission = 'restricted') THEN 'permission_restricted'
              WHEN NOT bool_or(contact_permission = 'permitted') THEN 'not_permitted' ELSE 'ok' END AS contact_gate
            FROM {fx_candidate} c LEFT JOIN {fx_source} s ON s.candidate_id = c.candidate_id GROUP BY 1"""),
        "status_transitions": oracle("""
            SELECT * FROM (SELECT t.vacancy_id, step, CASE WHEN is_deleted THEN 'vacancy_deleted'
              WHEN NOT concat(from_status, '>', to_status) IN ('draft>open', 'open>paused', 'open>closed', 'paused>open', 'paused>closed', 'closed>open') THEN 'transition_not_allowed'
              WHEN to_status = 'open' AND NOT requirements_confirmed THEN 'requirements_not_confirmed' END AS reason
            FROM {fx_transition} t JOIN {fx_vacancy} v ON v.vacancy_id = t.vacancy_id) WHERE reason IS NOT NULL"""),
        "profile_gate": oracle("""
            SELECT org_id, CASE WHEN is_deleted THEN 'document_deleted' WHEN document_type <> 'cv' THEN 'not_a_cv' WHEN extraction_status <> 'succeeded' THEN 'not_extracted'
              WHEN trim(coalesce(text, '')) = '' THEN 'no_text' WHEN length(text) > 60000 THEN 'text_too_long' ELSE 'ok' END AS profile_gate, count(*) AS n FROM {fx_document} GROUP BY 1, 2"""),
        "job_rollup": oracle("""
            SELECT job_id, count(*) AS tasks, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
              count(*) FILTER (status = 'queued') AS queued, CASE WHEN bool_or(status = 'queued') THEN 'running' WHEN bool_or(status IN ('skipped', 'failed')) THEN 'completed_with_errors' ELSE 'succeeded' END AS job_status
            FROM {fx_task} GROUP BY 1"""),
        "retry_selection": oracle("SELECT job_id, task_id, 'queued' AS status FROM {fx_task} WHERE status IN ('skipped', 'failed')"),
        "dashboard_counts": oracle("""
            SELECT org_id, (SELECT count(*) FROM {fx_member} m WHERE m.org_id = o.org_id AND m.is_active) AS active_clients, (SELECT count(*) FROM {fx_candidate} c WHERE c.org_id = o.org_id AND status = 'active') AS active_candidates,
              (SELECT count(*) FROM {fx_vacancy} v WHERE v.org_id = o.org_id AND status = 'open' AND NOT is_deleted) AS open_vacancies FROM {fx_organization} o"""),
        "retention_due": oracle("""
            SELECT 'candidate' AS kind, candidate_id, retention_until FROM {fx_candidate} WHERE status IN ('active', 'inactive') AND retention_until <= DATE '2024-06-30'
            UNION ALL SELECT 'source', s.candidate_id, s.retention_until FROM {fx_source} s JOIN {fx_candidate} c ON c.candidate_id = s.candidate_id WHERE status <> 'deleted' AND s.retention_until <= DATE '2024-06-30'
            UNION ALL SELECT 'document', d.candidate_id, DATE '2024-05-01' FROM (SELECT DISTINCT candidate_id FROM {fx_document} WHERE NOT is_deleted AND candidate_id > 0) d
              JOIN {fx_candidate} c ON c.candidate_id = d.candidate_id WHERE status IN ('active', 'inactive', 'deletion_requested')"""),
        "retention_missing": oracle("""
            SELECT org_id, count(*) FILTER (status IN ('active', 'inactive') AND retention_until IS NULL) AS candidates_without,
              coalesce((SELECT count(*) FROM {fx_source} s JOIN {fx_candidate} d ON d.candidate_id = s.candidate_id WHERE d.org_id = c.org_id AND d.status <> 'deleted' AND s.retention_until IS NULL), 0) AS sources_without
            FROM {fx_candidate} c GROUP BY org_id"""),
        "retention_dry_run": oracle("SELECT org_id, count(*) FILTER (status IN ('active', 'inactive') AND retention_until <= DATE '2024-06-30') AS flagged FROM {fx_candidate} GROUP BY 1"),
        "retention_snapshot": oracle("""
            SELECT candidate_id, CASE WHEN hit THEN 'deletion_requested' ELSE status END AS status, CASE WHEN hit THEN status ELSE '' END AS status_before_deletion_request
            FROM (SELECT *, coalesce(status IN ('active', 'inactive') AND retention_until <= DATE '2024-06-30', false) AS hit FROM {fx_candidate})"""),
        "pending_deletions": oracle("SELECT candidate_id, org_id FROM {fx_candidate} WHERE status = 'deletion_requested'"),
        "minimisation_issues": oracle("""
            SELECT 'deleted_candidate_retains_identity' AS code, candidate_id FROM {fx_candidate} WHERE status = 'deleted'
            UNION ALL SELECT DISTINCT 'deleted_candidate_retains_source', c.candidate_id FROM {fx_candidate} c JOIN {fx_source} s ON s.candidate_id = c.candidate_id WHERE status = 'deleted'
            UNION ALL SELECT DISTINCT 'deleted_candidate_retains_skill', c.candidate_id FROM {fx_candidate} c JOIN {fx_candidate_skill} s ON s.candidate_id = c.candidate_id WHERE status = 'deleted'"""),
        "purge_sources": oracle("SELECT s.candidate_id FROM {fx_source} s JOIN {fx_candidate} c ON c.candidate_id = s.candidate_id WHERE NOT (status = 'deletion_requested' AND c.candidate_id % 40 = 1)"),
        "audit_history": oracle("""
            SELECT org_id, kind, object_id, row_number() OVER (PARTITION BY org_id, kind ORDER BY t DESC, object_id DESC) AS position FROM (
              SELECT org_id, 'usage' AS kind, event_id AS object_id, started_at AS t FROM {fx_usage} UNION ALL SELECT CAST(o_custkey % 5 AS INT), 'vacancy', o_orderkey, o_orderdate FROM {orders}) QUALIFY position <= 50"""),
        "visible_candidates": oracle("""
            SELECT candidate_id, org_id FROM {fx_candidate} WHERE org_id IN (SELECT m.org_id FROM {fx_member} m JOIN {fx_organization} o ON o.org_id = m.org_id WHERE m.user_id = 4 AND m.is_active AND m.is_admin AND o.is_active)"""),
        "changed_candidates": oracle("WITH " + _BEFORE + """
            , skilled AS (SELECT DISTINCT candidate_id FROM {fx_candidate_skill_full} WHERE candidate_id % 41 = 0), x AS (
            SELECT coalesce(b.org_id, a.org_id) AS org_id, coalesce(b.candidate_id, a.candidate_id) AS candidate_id, CASE WHEN b.candidate_id IS NULL THEN 'added' WHEN a.candidate_id IS NULL THEN 'removed'
              WHEN a.location <> b.location OR a.candidate_id IN (SELECT candidate_id FROM skilled) THEN 'changed' END AS change
            FROM before b FULL JOIN after a ON a.candidate_id = b.candidate_id AND a.org_id = b.org_id) SELECT * FROM x WHERE change IS NOT NULL"""),
        "pool_signatures": oracle(f"""
            WITH lines AS (
              SELECT candidate_id, org_id, 'own ' || to_json(struct_pack(candidate_id := candidate_id, location := location))::VARCHAR AS line FROM {{fx_candidate}} WHERE status = 'active'
              UNION ALL SELECT candidate_id, NULL, 'skill ' || to_json(struct_pack(evidence := evidence, skill := skill, source_document_id := source_document_id, source_label := source_label, years_tenths := years_tenths))::VARCHAR FROM {{fx_candidate_skill_full}}
              UNION ALL SELECT candidate_id, NULL, 'profile ' || to_json(struct_pack(location := location, location_evidence := location_evidence))::VARCHAR FROM {{fx_profile}}
              UNION ALL SELECT candidate_id, NULL, 'fact ' || to_json(struct_pack(evidence := evidence, fact := fact, pos := pos, rule_type := rule_type))::VARCHAR FROM {{fx_profile_fact}}),
            h AS (SELECT candidate_id, max(org_id) AS org_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM lines GROUP BY 1 HAVING max(org_id) IS NOT NULL),
            b AS (SELECT org_id, candidate_id % 256 AS bucket, {_SUMS_SQL} FROM h GROUP BY 1, 2)
            SELECT org_id, sha256(concat_ws(':', n, s1, s2, s3, s4)) AS signature FROM (
              SELECT org_id, {_SUMS_SQL} FROM (SELECT org_id, sha256(concat_ws(':', n, s1, s2, s3, s4)) AS hash FROM b) GROUP BY 1)"""),
        "requirement_signatures": oracle("""
            WITH lines AS (
              SELECT requirements_id, true AS own, 'own ' || to_json(struct_pack(requirements_id := requirements_id, schema_version := schema_version, version := version))::VARCHAR AS line FROM {fx_requirement_version}
              UNION ALL SELECT requirements_id, false, 'skill ' || to_json(struct_pack(importance := importance, pos := pos, skill := skill))::VARCHAR FROM {fx_requirement_skill} WHERE requirements_id % 6 <> 1
              UNION ALL SELECT requirements_id, false, 'rule ' || to_json(struct_pack(expected := expected, rule_type := rule_type, tenths := tenths))::VARCHAR FROM {fx_rule})
            SELECT requirements_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS signature FROM lines GROUP BY 1 HAVING bool_or(own)"""),
        "staleness": oracle("""
            SELECT run_id, reasons <> '' AS is_stale, reasons FROM (SELECT requirements_id AS run_id, concat_ws(',', CASE WHEN requirements_id % 8 = 0 THEN 'scoring_algorithm_changed' END, CASE WHEN requirements_id % 9 = 0 THEN 'input_snapshot_unavailable' END,
              CASE WHEN requirements_id % 9 <> 0 AND requirements_id % 15 = 0 THEN 'vacancy_requirements_changed' END, CASE WHEN requirements_id % 9 <> 0 AND org_id = 1 THEN 'candidate_inputs_changed' END,
              CASE WHEN requirements_id % 10 = 0 THEN 'vacancy_deleted' END) AS reasons FROM {fx_requirements})"""),
        "pending_profiles": oracle("""
            SELECT candidate_id, document_id FROM (SELECT candidate_id, max(document_id) AS document_id FROM {fx_document} WHERE document_type = 'cv' AND NOT is_deleted GROUP BY 1) WHERE document_id % 3 <> 0"""),
        "reuse_results": oracle("SELECT document_id, CASE WHEN document_id % 7 = 0 THEN 'skipped' WHEN document_id % 5 = 0 THEN 'reused' ELSE 'created' END AS outcome FROM {fx_document}"),
        "decision_eligibility": oracle("""
            SELECT a.entry_id, version, CASE WHEN status <> 'active' THEN 'candidate_inactive' WHEN a.entry_id % 23 = 0 THEN 'vacancy_deleted' WHEN version <> top THEN 'not_latest_assessment'
              WHEN a.entry_id % 12 = 0 THEN 'profile_changed' WHEN changed THEN 'inputs_changed' ELSE 'ok' END AS decision_gate
            FROM {fx_review} a JOIN (SELECT entry_id, max(version) AS top FROM {fx_review} GROUP BY 1) t ON t.entry_id = a.entry_id JOIN {fx_candidate} c ON c.candidate_id = a.entry_id"""),
    }


_CATEGORY = "CASE WHEN changed THEN 0 WHEN gaps > 0 THEN 1 WHEN uncertain > 0 THEN 2 WHEN ambiguities > 0 THEN 3 ELSE 4 END"

QUERIES = (
    usage_overall, usage_breakdown, usage_period, usage_failures, usage_daily90, stale_pending, usage_completion, latest_version, next_version, review_queue, review_page, review_counts,
    contact_permission, status_transitions, profile_gate, job_rollup, retry_selection, dashboard_counts, retention_due, retention_missing, retention_dry_run, retention_snapshot, pending_deletions,
    minimisation_issues, purge_sources, audit_history, visible_candidates, changed_candidates, staleness, pool_signatures, requirement_signatures, pending_profiles, reuse_results, decision_eligibility,
)
