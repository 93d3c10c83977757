"""Queries of further operators: findings, drafts, drafts of versions, listings, profile rules and gates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir
from ..functions.normalize import taxonomy
from ..operators import grounding as G
from ..operators import ranking_eval as L
from ..operators import review as R
from ..operators import scoring as S
from ..operators import text_safety as X
from ..operators import usage as A
from ..operators import versions as V
from ..sources import files, sinks
from .fixtures import oracle, view


def finding_review(spark, sf_dir):
    """One finding a line item: stored and known evidence differ for some, explanations hold unproven numbers for some."""
    t = view(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    ev = lambda text: F.struct(n.cast("string").alias("id"), F.lit("skill").alias("label"), text.alias("evidence"))
    known = F.array(ev(F.when(F.col("l_partkey") % 5 == 0, "plays chess").otherwise("Spark for 3 years")))
    stored = F.when(F.col("l_suppkey") % 4 == 0, F.array().cast("array<struct<id:string,label:string,evidence:string>>")).otherwise(known)
    ref = F.struct(F.lit("Spark").alias("label"), F.lit("uses Spark").alias("evidence"))
    findings = t.select(
        F.col("l_orderkey").alias("assessment_id"), n.alias("line"), F.when(F.col("l_returnflag") == "A", "gap").otherwise("match").alias("category"),
        F.when(F.col("l_quantity") > 40, "has 9 years").when(F.col("l_quantity") < 5, "  ").otherwise("fits").alias("explanation"), ref.alias("requirement"), ref.alias("reference"), stored.alias("stored"), known.alias("known"),
    )
    return G.finding_issues(findings)


def finding_issues(spark, sf_dir):
    return finding_review(spark, sf_dir).select("assessment_id", "line", F.concat_ws(",", "issues").alias("issues"))


def assessment_reviews(spark, sf_dir):
    expected = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assessment_id"))
    rows = G.assessment_review(finding_review(spark, sf_dir), expected)
    return rows.select("assessment_id", "review", F.concat_ws(",", "issues").alias("issues"))


def issue_counts(spark, sf_dir):
    return G.issue_counts(G.assessment_review(finding_review(spark, sf_dir)))


def draft_checks(spark, sf_dir):
    o = view(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    body = F.concat(F.when(k % 3 == 0, "").otherwise("Dear [Candidate name], "), F.when(k % 5 == 0, "write to a@b.org ").otherwise("hello "), F.when(k % 7 == 0, "about a job offer").otherwise("there"))
    drafts = o.select(k.alias("draft_id"), F.when(k % 11 == 0, "Hi [Candidate name]").otherwise("Hi").alias("subject"), body.alias("body"))
    return X.draft_issues(drafts).select("draft_id", F.concat_ws(",", "issues").alias("issues"))


def export_texts(spark, sf_dir):
    o = view(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")  # the approved ones
    return o.select("o_orderkey", sinks.draft_text(F.col("o_orderpriority"), F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" "))).alias("text"))


def report_lines(spark, sf_dir):
    rows = A.overall(view(spark, sf_dir, "fx_usage"))
    return rows.select("org_id", sinks.metric_line("tokens", F.when(F.col("total_tokens_known") == F.col("attempts"), F.col("total_tokens")), F.col("total_tokens_known"), F.col("attempts")).alias("line"))


def carry_forward(spark, sf_dir):
    t = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("vacancy_id"), F.col("l_linenumber").alias("version"), F.when((F.col("l_linenumber") == 6), "draft").otherwise("confirmed").alias("status"), "l_partkey")
    return V.carry_forward(t, "vacancy_id", ["l_partkey"])


def batch_keys(spark, sf_dir):
    d = view(spark, sf_dir, "fx_document").select("org_id", F.col("document_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"), (F.col("document_id") % 50).alias("batch"))
    return V.batch_key(d, ["org_id", "batch"], "batch.v1")


def profile_rules(spark, sf_dir):
    """R4-R9 over customers: segments as employment types, nations as languages."""
    c, n = view(spark, sf_dir, "customer"), view(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    rows = c.filter("c_custkey % 10 <> 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("candidate_id"), F.when(k % 3 == 0, "remote").when(k % 3 == 1, "unknown").otherwise("").alias("work_mode"),
        F.array(F.struct(F.col("n_name").alias("language"), F.when(k % 2 == 0, "fluent").otherwise("").alias("proficiency"), F.lit("").alias("evidence"))).alias("languages"),
        F.array().cast("array<struct<qualification:string,institution:string,evidence:string>>").alias("education"),
        F.array(F.struct(F.concat(F.lit("Cert "), (k % 4).cast("string")).alias("name"), F.lit("").alias("issuer"), F.lit("").alias("evidence"))).alias("certifications"),
        F.array(F.lower("c_mktsegment")).alias("employment_types"),
    )
    kinds = [("work_mode", "remote"), ("language", "france fluent"), ("language", "france"), ("education", "msc"), ("certification", "cert 1"), ("employment_type", "building")]
    rule = F.explode(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(a).alias("rule_type"), F.lit(b).alias("expected_key")) for i, (a, b) in enumerate(kinds)]))
    pairs = c.select(k.alias("candidate_id"), rule.alias("r")).select("candidate_id", "r.*")
    return S.profile_rule_outcomes(pairs, S.profile_facts(rows, taxonomy), rows).select("candidate_id", "rule_id", "outcome", "reason")


def disjoint_groups(spark, sf_dir):
    s = view(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    both = s.select(k.alias("requirements_id"), F.array(F.concat(F.lit("Brand#"), (k % 7).cast("string")), F.lit("x ")).alias("must"), F.array(F.concat(F.lit("BRAND#"), (k % 5).cast("string"))).alias("nice"))
    return G.disjoint_issues(both).select("requirements_id")


def measurement_gate(spark, sf_dir):
    s, k = view(spark, sf_dir, "supplier"), F.col("s_suppkey")
    queries = s.select(k.alias("query_id"), F.when(k % 5 != 0, k).alias("requirements_id"))
    runs = s.filter("s_suppkey % 4 <> 0").select(k.alias("requirements_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id")).select("requirements_id", "run_id", ((F.col("run_id") == 2) & (F.col("requirements_id") % 3 == 0)).alias("is_stale"), (20 - (F.col("requirements_id") % 7 == 0).cast("int")).alias("candidates"))
    return L.measurement_gate(queries, runs, s.select(k.alias("query_id"), F.lit(20).alias("candidates")))


def candidate_listing(spark, sf_dir):
    return R.listing(view(spark, sf_dir, "fx_candidate"), "candidate", ("Customer#000000040", 40), 25).select("candidate_id", "full_name")


def vacancy_listing(spark, sf_dir):
    v = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vacancy_id"), F.col("o_orderdate").alias("created_at"))
    return R.listing(v, "vacancy", None, 20).select("vacancy_id")


def attached_skills(spark, sf_dir):
    rows = R.attach(view(spark, sf_dir, "fx_candidate").select("candidate_id"), view(spark, sf_dir, "fx_candidate_skill"), "candidate_id", "skill", 5)
    return rows.select("candidate_id", "n_children", "block", F.array_join(F.transform("children", lambda x: x["skill"]), ",").alias("skills"))


_F = """
f AS (SELECT l_orderkey AS a, l_linenumber AS line, l_returnflag = 'A' AS gap, l_suppkey % 4 = 0 AS bare, l_partkey % 5 = 0 AS chess, l_quantity > 40 AS nine, l_quantity < 5 AS silent FROM {lineitem}),
i AS (SELECT a, line, CASE WHEN bare THEN 1 END AS i1, CASE WHEN silent THEN 1 END AS i2, CASE WHEN NOT gap AND NOT bare AND NOT silent AND chess THEN 1 END AS i3, CASE WHEN nine THEN 1 END AS i4 FROM f)"""
_I = "concat_ws(',', CASE WHEN %s THEN 'invalid_explanation_text' END, CASE WHEN %s THEN 'match_without_lexical_support' END, CASE WHEN %s THEN 'missing_required_evidence' END, CASE WHEN %s THEN 'unsupported_measured_claim' END)"


def denormalised_entries(spark, sf_dir):
    """Entries with their run, candidate and, through the candidate, organisation."""
    v = lambda n: view(spark, sf_dir, n)
    parents = {"run": (v("fx_run"), "run_id", "run_id"), "candidate": (v("fx_candidate"), "candidate_id", "candidate_id"), "organization": (v("fx_organization"), "candidate_org_id", "org_id")}
    rows = R.denormalise(v("fx_entry"), parents)
    return rows.select("run_id", "candidate_id", "rank", "run_eligible_count", "candidate_full_name", "candidate_location", "organization_slug", "organization_is_active")


def stored_events(spark, sf_dir):
    """A ledger with odd values, cleaned and stored as two batches, each tried twice."""
    e = view(spark, sf_dir, "fx_usage").select(
        "event_id", "org_id", F.concat(F.lit("  "), "model", F.lit(" ")).alias("model"), F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.col("total_tokens")).alias("total_tokens"),
        F.when(F.col("event_id") % 9 == 0, -1 - F.col("duration_ms")).otherwise(F.col("duration_ms")).alias("duration_ms"),
    )
    path = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    for batch in (0, 1, 0, 1):
        sinks.append_events(e.filter(F.col("event_id") % 2 == batch), path, f"part-{batch}")
    return sinks.read_committed(spark, path, "events").select("event_id", "org_id", "model", "total_tokens", "duration_ms")


def imported_csv(spark, sf_dir):
    """Whole texts, line ends and quotes included, written as CSV files and read back in blocks by the strict reader."""
    rows = view(spark, sf_dir, "documents").select(
        F.concat(F.lit("Candidate "), F.col("doc_id")).alias("full_name"), F.coalesce("text", F.lit("")).alias("location"), F.concat(F.lit('ref,"'), F.col("doc_id")).alias("source_reference")
    )
    path = f"{checkpoint_dir(spark)}/imports-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = files.candidate_csv(spark, path)
    return read.select("full_name", "email", "source_reference", F.length("location").cast("long").alias("n_chars"), F.sha2(F.col("location").cast("binary"), 256).alias("location_sha256"), "extra_values")


def sql() -> dict[str, str]:
    sorted_ = _I % ("max(i2) = 1", "max(i3) = 1", "max(i1) = 1", "max(i4) = 1")
    return {
        "finding_issues": oracle("WITH " + _F + " SELECT a AS assessment_id, line, concat_ws(',', CASE WHEN i1 = 1 THEN 'missing_required_evidence' END, CASE WHEN i2 = 1 THEN 'invalid_explanation_text' END, CASE WHEN i3 = 1 THEN 'match_without_lexical_support' END, CASE WHEN i4 = 1 THEN 'unsupported_measured_claim' END) AS issues FROM i"),
        "assessment_reviews": oracle("WITH " + _F + ", g AS (SELECT a, " + sorted_ + " AS issues FROM i GROUP BY 1) SELECT o_orderkey AS assessment_id, CASE WHEN issues IS NULL THEN 'unavailable' WHEN issues = '' THEN 'clean' ELSE 'flagged' END AS review, coalesce(issues, '') AS issues FROM {orders} LEFT JOIN g ON a = o_orderkey"),
        "issue_counts": oracle("WITH " + _F + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS issue, count(DISTINCT a) AS n FROM i WHERE i{k} = 1" for k, n in ((1, "missing_required_evidence"), (2, "invalid_explanation_text"), (3, "match_without_lexical_support"), (4, "unsupported_measured_claim"))) + ") WHERE n > 0"),
        "draft_checks": oracle("""
            SELECT o_orderkey AS draft_id, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'contact_data' END, CASE WHEN o_orderkey % 7 = 0 THEN 'offer_wording' END,
              CASE WHEN o_orderkey % 3 = 0 THEN 'placeholder_not_once' END, CASE WHEN o_orderkey % 11 = 0 THEN 'placeholder_in_subject' END) AS issues FROM {orders}"""),
        "export_texts": oracle("SELECT o_orderkey, concat('Subject: ', trim(o_orderpriority), chr(10), chr(10), o_orderstatus, chr(10)) AS text FROM {orders} WHERE o_orderstatus = 'F'"),
        "report_lines": oracle("SELECT org_id, CASE WHEN count(total_tokens) = count(*) THEN concat('tokens: ', CAST(sum(total_tokens) AS STRING)) ELSE concat('tokens: unavailable (', CAST(count(total_tokens) AS STRING), '/', CAST(count(*) AS STRING), ')') END AS line FROM {fx_usage} GROUP BY 1"),
        "carry_forward": oracle("""
            WITH t AS (SELECT l_orderkey AS vacancy_id, l_linenumber AS version, l_partkey FROM {lineitem})
            SELECT vacancy_id, l_partkey, CAST(version + 1 AS INT) AS version, 'draft' AS status FROM t QUALIFY row_number() OVER (PARTITION BY vacancy_id ORDER BY version DESC, l_partkey) = 1 AND count(*) FILTER (version = 6) OVER (PARTITION BY vacancy_id) = 0"""),
        "profile_rules": oracle("""
            WITH c AS (SELECT c_custkey AS k, lower(n_name) AS l, lower(c_mktsegment) AS m FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey),
            r AS (SELECT 0 AS rule_id UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5),
            x AS (SELECT k, rule_id, CASE rule_id WHEN 0 THEN k % 3 = 0 WHEN 1 THEN l = 'france' AND k % 2 = 0 WHEN 2 THEN l = 'france' WHEN 3 THEN false WHEN 4 THEN k % 4 = 1 ELSE m = 'building' END AS hit,
                    CASE rule_id WHEN 0 THEN k % 3 = 0 WHEN 3 THEN false ELSE true END AS has FROM c CROSS JOIN r)
            SELECT k AS candidate_id, rule_id, CASE WHEN hit AND k % 10 <> 0 THEN 'passed' ELSE 'unknown' END AS outcome,
              CASE WHEN k % 10 = 0 THEN 'no_profile' WHEN hit THEN 'matched' WHEN NOT has THEN 'no_fact' ELSE 'no_match' END AS reason FROM x"""),
        "disjoint_groups": oracle("SELECT s_suppkey AS requirements_id FROM {supplier} WHERE s_suppkey % 7 = s_suppkey % 5"),
        "measurement_gate": oracle("""
            SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 5 = 0 THEN 'no_current_requirements' WHEN s_suppkey % 4 = 0 THEN 'no_run' WHEN s_suppkey % 3 = 0 THEN 'run_is_stale' WHEN s_suppkey % 7 = 0 THEN 'pool_incomplete' ELSE 'ok' END AS measurement_gate FROM {supplier}"""),
        "candidate_listing": oracle("SELECT candidate_id, full_name FROM {fx_candidate} WHERE full_name > 'Customer#000000040' OR (full_name = 'Customer#000000040' AND candidate_id > 40) ORDER BY full_name, candidate_id LIMIT 25"),
        "vacancy_listing": oracle("SELECT o_orderkey AS vacancy_id FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
        "attached_skills": oracle("""
            WITH s AS (SELECT *, CAST((row_number() OVER (PARTITION BY candidate_id ORDER BY skill) - 1) // 5 AS INT) AS block, count(*) OVER (PARTITION BY candidate_id) AS n FROM {fx_candidate_skill})
            SELECT c.candidate_id, coalesce(n, 0) AS n_children, coalesce(block, 0) AS block, string_agg(skill, ',' ORDER BY skill) AS skills
            FROM {fx_candidate} c LEFT JOIN s ON s.candidate_id = c.candidate_id GROUP BY 1, 2, 3"""),
        "denormalised_entries": oracle("""
            SELECT e.run_id, e.candidate_id, e.rank, r.eligible_count AS run_eligible_count, c.full_name AS candidate_full_name, c.location AS candidate_location, o.slug AS organization_slug, o.is_active AS organization_is_active
            FROM {fx_entry} e LEFT JOIN {fx_run} r ON r.run_id = e.run_id LEFT JOIN {fx_candidate} c ON c.candidate_id = e.candidate_id LEFT JOIN {fx_organization} o ON o.org_id = c.org_id"""),
        "stored_events": oracle("""
            SELECT event_id, org_id, model, CASE WHEN event_id % 5 <> 0 THEN total_tokens END AS total_tokens, CASE WHEN event_id % 9 <> 0 THEN CAST(duration_ms AS DECIMAL(16,3)) END AS duration_ms FROM {fx_usage}"""),
        "imported_csv": oracle("""
            SELECT concat('Candidate ', doc_id) AS full_name, '' AS email, concat('ref,"', doc_id) AS source_reference, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS location_sha256, false AS extra_values FROM {documents}"""),
        "batch_keys": oracle("""
            WITH d AS (SELECT org_id, document_id % 50 AS batch, concat(CAST(document_id AS STRING), ':', sha256(coalesce(text, ''))) AS member FROM {fx_document})
            SELECT org_id, batch, sha256(concat_ws('|', 'batch.v1', CAST(org_id AS STRING), CAST(batch AS STRING), string_agg(member, ',' ORDER BY member))) AS batch_key FROM d GROUP BY 1, 2"""),
    }


QUERIES = (
    finding_issues, assessment_reviews, issue_counts, draft_checks, export_texts, report_lines, carry_forward, batch_keys, profile_rules, disjoint_groups, measurement_gate, candidate_listing, vacancy_listing, attached_skills, denormalised_entries, stored_events, imported_csv,
)
