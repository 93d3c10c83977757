"""Views that give the given tables the shape of recruiting data.

Each view is SQL that Spark and DuckDB both read, so the same text makes the
Spark input and the common table expression of the oracle.  ``{name}`` stands
for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_organization": "SELECT r_regionkey AS org_id, lower(r_name) AS slug, r_regionkey <> 4 AS is_active FROM {region}",
    "fx_candidate": """
        SELECT c_custkey AS candidate_id, n_regionkey AS org_id, c_name AS full_name,
               CASE WHEN c_custkey % 7 = 0 THEN '' ELSE n_name END AS location,
               CASE c_custkey % 20 WHEN 0 THEN 'inactive' WHEN 1 THEN 'deletion_requested' WHEN 2 THEN 'deleted' ELSE 'active' END AS status,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(c_custkey % 400 AS INT) END AS retention_until
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "fx_candidate_skill": """
        SELECT o_custkey AS candidate_id, p_brand AS skill, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(MAX(l_quantity) AS INT) % 120 END AS years_tenths
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey
        WHERE p_size <= 5 GROUP BY o_custkey, p_brand""",
    "fx_candidate_skill_sparse": """
        SELECT o_custkey AS candidate_id, p_brand AS skill, CAST(MAX(l_quantity) AS INT) % 120 AS years_tenths
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey
        WHERE p_size = 1 AND l_linenumber = 1 GROUP BY o_custkey, p_brand""",
    "fx_candidate_skill_full": """
        SELECT candidate_id, skill, years_tenths, concat('label of ', skill) AS source_label, concat('used "', skill, '" for years') AS evidence, CASE WHEN candidate_id % 4 <> 0 THEN candidate_id * 10 END AS source_document_id
        FROM {fx_candidate_skill}""",
    "fx_requirement_version": """
        SELECT requirements_id, org_id, CASE WHEN requirements_id % 29 = 0 THEN 2 ELSE 1 END AS version, 'requirements.v1' AS schema_version FROM {fx_requirements}""",
    "fx_requirements": """
        SELECT s_suppkey AS requirements_id, n_regionkey AS org_id, n_name AS location,
               CASE WHEN s_suppkey % 29 = 0 THEN 'draft' ELSE 'confirmed' END AS status, s_suppkey % 31 = 0 AS vacancy_deleted
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "fx_profile": """
        SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 14 = 0 THEN concat(' ', n_name) ELSE '' END AS location, concat('lives in ', n_name) AS location_evidence
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0""",
    "fx_profile_fact": """
        SELECT c_custkey AS candidate_id, 'language' AS rule_type, 0 AS pos, concat(n_name, ' Fluent') AS fact, concat('speaks ', n_name) AS evidence
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0 AND c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 'language', 1, n_name, concat('speaks ', n_name) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0
        UNION ALL SELECT c_custkey, 'work_mode', 0, 'remote', 'wants to work from home' FROM {customer} WHERE c_custkey % 10 <> 0 AND c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'certification', 0, concat('Cert ', CAST(c_custkey % 4 AS STRING)), 'holds it' FROM {customer} WHERE c_custkey % 10 <> 0
        UNION ALL SELECT c_custkey, 'employment_type', 0, c_mktsegment, 'asked for it' FROM {customer} WHERE c_custkey % 10 <> 0""",
    "fx_requirement_skill": """
        SELECT s_suppkey AS requirements_id, k AS pos, concat('Brand#', CAST((s_suppkey * 7 + k * 3) % 25 + 1 AS STRING)) AS skill,
               CASE WHEN k < 2 THEN 'must_have' ELSE 'nice_to_have' END AS importance
        FROM {supplier} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks""",
    "fx_rule": """
        SELECT s_suppkey AS requirements_id, 'location' AS rule_type, n_name AS expected, 0 AS tenths
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0
        UNION ALL SELECT s_suppkey, 'required_skill', concat('Brand#', CAST(s_suppkey * 7 % 25 + 1 AS STRING)), 0 FROM {supplier} WHERE s_suppkey % 2 = 0
        UNION ALL SELECT s_suppkey, 'minimum_experience', '', 40 FROM {supplier} WHERE s_suppkey % 5 = 0
        UNION ALL SELECT s_suppkey, 'language', concat('  ', lower(n_name)), 0 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 1
        UNION ALL SELECT s_suppkey, 'work_mode', 'Remote', 0 FROM {supplier} WHERE s_suppkey % 7 = 3
        UNION ALL SELECT s_suppkey, 'certification', 'cert  1', 0 FROM {supplier} WHERE s_suppkey % 9 = 2
        UNION ALL SELECT s_suppkey, 'employment_type', 'building', 0 FROM {supplier} WHERE s_suppkey % 8 = 5
        UNION ALL SELECT s_suppkey, 'education', 'MSc', 0 FROM {supplier} WHERE s_suppkey % 23 = 0""",
    "fx_usage": """
        SELECT event_id, CAST(user_id % 5 AS INT) AS org_id,
               CASE event_type WHEN 'view' THEN 'vacancy_requirements' WHEN 'click' THEN 'candidate_profile' WHEN 'purchase' THEN 'match_assessment' ELSE 'outreach_draft' END AS workflow,
               CASE WHEN event_id % 10 = 3 THEN 'pending' WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
               CASE WHEN event_id % 10 = 3 OR event_type = 'error' THEN '' ELSE concat('m', CAST(user_id % 3 AS STRING)) END AS model,
               CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('req', CAST(event_id AS STRING)) END AS provider_request_id,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) END AS total_tokens,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 900 AS INT) END AS duration_ms,
               CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 2 = 0 THEN 'gateway' WHEN event_id % 3 = 0 THEN 'odd' ELSE 'application' END AS failure_stage,
               CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 3 = 0 THEN 'ai_request_failed' WHEN event_id % 3 = 1 THEN 'ai_service_unavailable' ELSE 'unexpected' END AS failure_code,
               CAST(event_id % 3 AS INT) AS retries_used, ts AS started_at
        FROM {events}""",
    "fx_source": """
        SELECT c_custkey AS candidate_id,
               CASE c_custkey % 6 WHEN 0 THEN 'restricted' WHEN 1 THEN 'withdrawn' WHEN 2 THEN 'unknown' ELSE 'permitted' END AS contact_permission,
               CASE WHEN c_custkey % 11 = 0 THEN 'withdrawn' ELSE 'granted' END AS consent_status,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE DATE '2024-02-01' + CAST(c_custkey % 300 AS INT) END AS retention_until
        FROM {customer} WHERE c_custkey % 9 <> 0""",
    "fx_document": """
        SELECT doc_id AS document_id, doc_id % 500 AS candidate_id, CAST(doc_id % 5 AS INT) AS org_id, text, n_chars AS size_chars,
               CASE WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'succeeded' END AS extraction_status, CASE WHEN doc_id % 4 = 3 THEN 'other' ELSE 'cv' END AS document_type,
               doc_id % 17 = 0 AS is_deleted FROM {documents}""",
    "fx_registry": """
        SELECT concat('store/', CAST(document_id AS STRING)) AS path, text, is_deleted, extraction_status, document_type,
               CASE document_id % 11 WHEN 3 THEN 'text/plain' WHEN 5 THEN NULL WHEN 6 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/pdf' END AS content_type,
               CASE document_id % 9 WHEN 1 THEN ' / ' WHEN 2 THEN concat('up/', chr(7), '.pdf') WHEN 4 THEN repeat('n', 256) WHEN 7 THEN NULL ELSE concat('a/b/ cv ', CAST(document_id AS STRING), '.pdf ') END AS original_filename,
               CASE WHEN document_id % 19 = 0 THEN 1 ELSE 0 END AS size_error, document_id % 23 = 0 AS hash_lost, document_id % 29 <> 0 AS stored,
               CASE WHEN candidate_id % 20 = 2 THEN 'deleted' ELSE 'active' END AS candidate_status
        FROM {fx_document}""",
    "fx_assessment": "SELECT conv_id AS entry_id, turn + 1 AS version, length(text) % 101 AS score FROM {conversations}",
    "fx_review": """
        SELECT conv_id AS entry_id, turn + 1 AS version, CAST(length(text) % 3 AS INT) AS gaps, CAST(length(text) % 4 AS INT) AS uncertain,
               CAST(length(text) % 2 AS INT) AS ambiguities, length(text) % 7 = 0 AS changed,
               CASE length(text) % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'revisit' ELSE 'pending' END AS decision
        FROM {conversations}""",
    "fx_judgment": """
        SELECT d.lang AS query_id, d.doc_id, quality * 2 + (1 - toxic) AS grade, row_number() OVER (PARTITION BY d.lang ORDER BY n_chars DESC, d.doc_id) AS rnk
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "fx_import": """
        SELECT o_orderkey AS row_number, CAST(o_custkey % 5 AS INT) AS org_id, concat('c', CAST(o_custkey % 400 AS STRING), '@x.test') AS email,
               concat('555', lpad(CAST(o_orderkey * 7919 % 9000 AS STRING), 6, '0')) AS phone, concat('ref', CAST(o_orderkey % 3000 AS STRING)) AS source_reference
        FROM {orders}""",
    "fx_pool": """
        SELECT c_custkey AS candidate_id, n_regionkey AS org_id, concat('c', CAST(c_custkey % 90 AS STRING), '@x.test') AS email,
               concat('555', lpad(CAST(c_custkey * 131 % 9000 AS STRING), 6, '0')) AS phone, concat('ref', CAST(c_custkey * 7 AS STRING)) AS source_reference
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "fx_member": "SELECT s_suppkey AS user_id, n_regionkey AS org_id, s_suppkey % 4 = 0 AS is_admin, s_suppkey % 6 <> 0 AS is_active FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "fx_task": """
        SELECT l_orderkey AS job_id, l_linenumber AS task_id,
               CASE WHEN l_quantity < 10 THEN 'failed' WHEN l_quantity < 14 THEN 'skipped' WHEN l_quantity < 16 AND l_returnflag = 'N' THEN 'queued' ELSE 'succeeded' END AS status
        FROM {lineitem}""",
    "fx_vacancy": """
        SELECT o_orderkey AS vacancy_id, CAST(o_custkey % 5 AS INT) AS org_id,
               CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'draft' END AS status, o_orderkey % 19 = 0 AS is_deleted FROM {orders}""",
    "fx_run": """
        SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE 20 END AS shortlist_limit, CAST(floor(o_totalprice) AS INT) % 100 AS evaluated_count, CAST(o_custkey % 60 AS INT) AS eligible_count, CAST(o_orderkey % 25 AS INT) AS shortlisted_count FROM {orders}""",
    "fx_entry": """
        SELECT l_orderkey + CASE WHEN l_partkey % 100 = 0 THEN 100000000 ELSE 0 END AS run_id, l_suppkey AS candidate_id, l_linenumber - CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS rank, CAST(floor(l_quantity) AS INT) * 2 + 5 AS score,
               CASE WHEN l_returnflag = 'A' AND l_tax > 0.07 THEN 'failed' ELSE 'passed' END AS filter_outcome, l_linenumber % 4 AS matched_must, 2 AS total_must FROM {lineitem}""",
    "fx_audit": """
        SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 'candidate_deleted' WHEN 1 THEN 'candidate_document_downloaded' WHEN 2 THEN 'vacancy_deleted' WHEN 3 THEN 'renamed' ELSE 'candidate_retention_flagged' END AS action,
               CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'vacancy' WHEN 1 THEN 'candidate_document' WHEN 2 THEN 'client' ELSE 'candidate' END AS object_type FROM {events}""",
    "fx_attempt": """
        SELECT event_id, status, CASE WHEN event_id % 37 = 0 THEN NULL WHEN status = 'pending' THEN NULL ELSE started_at END AS completed_at, failure_stage, CASE WHEN event_id % 41 = 0 THEN '' ELSE failure_code END AS failure_code, provider_request_id, model,
               CASE WHEN status = 'succeeded' THEN 'profile' ELSE '' END AS result_type, CASE WHEN status = 'succeeded' AND event_id % 43 <> 0 THEN event_id END AS result_id FROM {fx_usage}""",
    "fx_person": """
        SELECT candidate_id, org_id, status, CASE WHEN status = 'deleted' AND candidate_id % 3 <> 0 THEN DATE '2024-05-01' END AS deleted_at, CASE WHEN status = 'deletion_requested' AND candidate_id % 4 <> 1 THEN DATE '2024-04-01' END AS deletion_requested_at FROM {fx_candidate}""",
    "fx_transition": """
        SELECT l_orderkey AS vacancy_id, l_linenumber AS step,
               CASE l_returnflag WHEN 'A' THEN 'draft' WHEN 'R' THEN 'open' ELSE 'paused' END AS from_status,
               CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'closed' END AS to_status, l_linenumber % 3 <> 0 AS requirements_confirmed
        FROM {lineitem}""",
}


def _needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n in TABLES or n in VIEWS]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over the tables, of one folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = _needs(VIEWS[name])
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs})


def oracle(sql: str) -> str:
    """sql with the views that it names in braces as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in TABLES and name not in order:
            for n in _needs(VIEWS[name]):
                visit(n)
            order.append(name)

    for name in _needs(sql):
        visit(name)
    plain = lambda text: re.sub(r"\{([a-z]\w+)\}", r"\1", text)
    body = plain(sql).strip()
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
