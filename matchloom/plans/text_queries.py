"""Queries of the intake, text, grounding, evaluation and rule areas."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import grounding as G
from ..operators import intake as I
from ..operators import quality_rules as Q
from ..operators import ranking_eval as L
from ..operators import text_safety as X
from .fixtures import oracle, view


def dup_documents(spark, sf_dir):
    return I.content_duplicates(view(spark, sf_dir, "fx_document"))


def dup_identity(spark, sf_dir):
    return I.identity_matches(view(spark, sf_dir, "fx_import"), view(spark, sf_dir, "fx_pool"))


def csv_triage(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_import")
    return I.triage(rows, view(spark, sf_dir, "fx_pool"), F.col("row_number") % 11 != 0).select("org_id", "row_number", "status")


def import_counts(spark, sf_dir):
    return I.import_counts(csv_triage(spark, sf_dir))


def batch_counts(spark, sf_dir):
    items = view(spark, sf_dir, "fx_task").select(F.col("job_id").alias("batch_id"), F.when(F.col("status") == "queued", "pending").when(F.col("status") == "succeeded", "created").otherwise("discarded").alias("status"))
    batches = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("open").alias("batch_status"))
    return I.batch_counts(batches, items)


def skill_vocabulary(spark, sf_dir):
    labels = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    labels = labels.select((F.col("l_orderkey") % 5).cast("int").alias("org_id"), F.concat(F.lit("  "), F.col("p_type"), F.lit("  "), F.col("p_brand")).alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    held = view(spark, sf_dir, "part").select(F.lit(0).alias("org_id"), F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("normalized_name")).distinct()
    return I.resolve_skills(labels, held)[1].select("org_id", "normalized_name")


def identity_flags(spark, sf_dir):
    rows = I.propose(view(spark, sf_dir, "documents").withColumn("file", F.concat(F.lit("cv_jane_doe_"), F.col("doc_id").cast("string"), F.lit(".pdf"))), "text", "file")
    return rows.select("doc_id", "proposal.full_name", "proposal.email", "proposal.phone", "proposal.location", F.concat_ws(",", "proposal.review_flags").alias("flags"))


def email_counts(spark, sf_dir):
    found = I.emails(F.coalesce("text", F.lit("")))
    return view(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_emails"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("first_email"))


def redaction_counts(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text")).alias("r"), X.sensitive(F.col("text")).alias("sensitive"))
    return docs.select("doc_id", (F.size(F.split("r", r"\[CONTACT REDACTED\]", -1)) - 1).alias("redactions"), "sensitive")


def document_delivery(spark, sf_dir):
    """Registered documents against stored bytes, some of another size or hash, some missing."""
    r = view(spark, sf_dir, "fx_registry").withColumn("content", F.coalesce("text", F.lit("")).cast("binary"))
    registry = r.withColumn("size_bytes", F.length("content") + F.col("size_error")).withColumn("sha256", F.when(~F.col("hash_lost"), F.sha2("content", 256)))
    return I.delivery(registry.drop("content", "text"), r.filter("stored").select("path", "content"))


def known_value_redaction(spark, sf_dir):
    """Each text without values known of its candidate: words of its own in another case, parts of the label, one that isn't there."""
    docs = view(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("w", F.split(F.regexp_replace("text", r"[^A-Za-z0-9]+", " "), " "))
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    values = F.array(F.upper(word(1)), F.concat_ws(" ", word(2), word(3)), F.lit(" redacted] "), F.lower(word(5)), F.lit("act"), F.lit("no such [value]"), F.lit(None).cast("string"))
    done = docs.select("doc_id", X.redact_values(F.col("text"), values).alias("r"))
    return done.select("doc_id", F.length("r").cast("long").alias("n_chars"), F.sha2(F.col("r").cast("binary"), 256).alias("redacted_sha256"))


def email_redaction(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), X.EMAIL, X.REDACTED).cast("binary"), 256).alias("redacted_sha256"))


def _said(spark, sf_dir):
    """Texts with claims: turns of conversations, with a number, a quotation and a protected word put into some."""
    c = view(spark, sf_dir, "conversations")
    n, t = F.col("conv_id") % 23, F.col("turn")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(t % 2 == 0, F.concat(F.lit(" over "), n.cast("string"), F.lit(" years "))).otherwise(" twelve months "), F.when(n % 3 == 0, ' said "hello there" ').otherwise(""), F.when(n % 5 == 0, " her nationality ").otherwise(""))
    return c.select("conv_id", "turn", text.alias("text"))


def claim_issues(spark, sf_dir):
    rows = _said(spark, sf_dir)
    sources = F.array(F.lit("12 months and 4 years"), F.when(F.col("conv_id") % 2 == 0, "She said Hello  There to all").otherwise("nothing"))
    return rows.select("conv_id", "turn", F.concat_ws(",", G.text_issues(F.col("text"), sources)).alias("issues"))


def measured_claims(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", F.concat_ws("|", X.measured_claims(F.col("text"))).alias("claims"))


def protected_language(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", "turn", X.protected(F.col("text")).alias("protected"))


def meaningful_tokens(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", F.explode(X.meaningful_tokens(F.col("text"))).alias("token"))


def _profiles(spark, sf_dir):
    """Profiles made of conversations: first words of a turn as facts, with evidence from it or from elsewhere."""
    c = view(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    words = F.split("text", " ")
    item = F.struct(F.array_join(F.slice(words, 1, 2), " ").alias("name"), F.when(F.col("turn") % 2 == 0, F.array_join(F.slice(words, 1, 4), " ")).otherwise(F.array_join(F.slice(words, 2, 3), " ")).alias("evidence"), F.lit(None).cast("decimal(4,1)").alias("years_experience"))
    empty = {g: F.array().cast(t) for g, t in (
        ("employment", "array<struct<job_title:string,employer:string,period:string,evidence:string>>"), ("languages", "array<struct<language:string,proficiency:string,evidence:string>>"),
        ("education", "array<struct<qualification:string,institution:string,evidence:string>>"), ("certifications", "array<struct<name:string,issuer:string,evidence:string>>"), ("employment_types", "array<string>"),
    )}
    blank = {n: F.lit("") for n in ("summary", "summary_evidence", "location", "location_evidence", "work_mode", "work_mode_evidence", "availability", "availability_evidence", "employment_types_evidence")}
    profiles = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("skills"))
    return profiles.withColumnRenamed("conv_id", "profile_id").withColumns({**empty, **blank})


def grounding_issues(spark, sf_dir):
    """Claims of profiles made of conversations against their other turns."""
    c = view(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    sources = c.filter("turn <> 2").groupBy(F.col("conv_id").alias("profile_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return G.evidence_issues(G.profile_claims(_profiles(spark, sf_dir)), sources).select("profile_id", "label", "reason")


def _fields(spark, sf_dir):
    """Requirements with all fields that can be references; one in seven has neither skills nor fields but a summary or nothing."""
    r, k = view(spark, sf_dir, "fx_requirements"), F.col("requirements_id")
    bare = k % 7 == 0
    return r.select(
        k, F.when(~bare, F.col("location")).alias("location"), F.when(~bare & (k % 5 == 0), F.lit(4.5)).cast("decimal(4,1)").alias("minimum_experience"), F.when(~bare & (k % 3 == 0), "Remote").otherwise("unknown").alias("work_mode"),
        F.when(bare, None).otherwise("Full-time").alias("employment_type"), F.when(~bare & (k % 4 == 1), F.array(F.lit("Latin"), F.col("location"))).alias("language"), F.when(~bare & (k % 6 == 0), F.array(F.lit("MSc"))).alias("education"),
        F.when(k % 14 == 0, "  about the job ").otherwise(" ").alias("summary"),
    )


def requirement_refs(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return G.requirement_references(_fields(spark, sf_dir), v("fx_requirement_skill").filter("requirements_id % 7 <> 0"), v("fx_rule").filter("requirements_id % 7 <> 0"))


def requirement_bounds(spark, sf_dir):
    """G1: requirements without references, or with more than eight."""
    return G.reference_bounds(view(spark, sf_dir, "fx_requirements"), requirement_refs(spark, sf_dir), 8)


def evidence_refs(spark, sf_dir):
    """Turns of a chat as skills of a profile, with years for some, and a summary for some."""
    p = _profiles(spark, sf_dir)
    item = lambda x, i: F.struct(x["name"].alias("name"), x["evidence"].alias("evidence"), F.when(i % 2 == 1, F.lit(2.5)).cast("decimal(4,1)").alias("years_experience"))
    p = p.withColumns({"skills": F.transform("skills", item), "summary": F.when(F.col("profile_id") % 3 == 0, "short").otherwise(""), "summary_evidence": F.when(F.col("profile_id") % 6 == 0, "shown").otherwise(""), "work_mode": F.lit("unknown"), "work_mode_evidence": F.lit("x"),
                       "availability": F.lit("now"), "availability_evidence": F.lit("said so"), "employment_types": F.array(F.lit("full-time"), F.lit("contract")), "employment_types_evidence": F.when(F.col("profile_id") % 2 == 0, "asked").otherwise("")})
    return G.evidence_references(p)


def reference_issues(spark, sf_dir):
    t = view(spark, sf_dir, "lineitem")
    findings = t.select(F.col("l_orderkey").alias("assessment_id"), (F.col("l_linenumber") % 5).cast("string").alias("requirement_id"), F.when(F.col("l_tax") < 0.02, "gap").otherwise("match").alias("category"),
                        F.when(F.col("l_quantity") > 5, F.array((F.col("l_partkey") % 4).cast("string"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    ids = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assessment_id"))
    required = ids.select("assessment_id", F.explode(F.array(*[F.lit(str(i)) for i in range(1, 4)])).alias("requirement_id"))
    known = ids.select("assessment_id", F.explode(F.array(*[F.lit(str(i)) for i in range(3)])).alias("evidence_id"))
    return G.reference_issues(findings, required, known)


def context_sizes(spark, sf_dir):
    rows = G.context_size(view(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r'["\\\x00-\x1f]', " ").alias("text")), 600)
    return rows.select("conv_id", "turn", "context_chars", "fits")


def ndcg_at5(spark, sf_dir):
    j = view(spark, sf_dir, "fx_judgment")
    return L.at_k(j.select("query_id", "doc_id", "rnk"), j.select("query_id", "doc_id", "grade"))


def ndcg_macro(spark, sf_dir):
    return L.macro(ndcg_at5(spark, sf_dir), "ndcg", "precision")


def overlap_at5(spark, sf_dir):
    j = view(spark, sf_dir, "fx_judgment")
    expected = j.select("query_id", (F.col("doc_id") + F.when(F.col("rnk") % 2 == 0, 1_000_000).otherwise(0)).alias("doc_id"), "rnk")
    return L.overlap_at_k(j, expected)


def coverage_gate(spark, sf_dir):
    """Every version of an assessment as an entry of its own."""
    entry = F.col("entry_id") * 97 + F.col("version")
    rows = view(spark, sf_dir, "fx_assessment").select(entry.alias("entry_id"), "score")
    a = rows.select("entry_id", "score", F.col("entry_id").alias("profile_id"))
    e = rows.select((F.col("entry_id") % 10).alias("query_id"), "entry_id", F.col("entry_id").alias("rank"), F.when(F.col("entry_id") % 50 == 3, -1).otherwise(F.col("entry_id")).alias("current_profile"))
    return L.coverage_gate(e, a)


def binding_issues(spark, sf_dir):
    codes = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return L.binding_issues(codes, view(spark, sf_dir, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 16 == 0, 100_000_000).otherwise(0)).alias("code")))


def ranking_differences(spark, sf_dir):
    j = view(spark, sf_dir, "fx_judgment").select("query_id", "rnk", F.col("doc_id").alias("code"), F.col("grade").alias("score"))
    wanted = j.filter("rnk % 9 <> 0").withColumn("score", F.when(F.col("rnk") % 5 == 0, -1).otherwise(F.col("score")))
    return L.ranking_differences(j, wanted).select("query_id", "rnk")


RULES = [
    Q.Check("candidate_status_domain", "fx_candidate", "candidate_id", "status in ('active', 'inactive', 'deletion_requested')"),
    Q.Check("candidate_location_present", "fx_candidate", "candidate_id", "location <> ''"),
    Q.Check("retention_date_order", "fx_candidate", "candidate_id", "retention_until < date'2025-01-01'"),
    Q.Check("usage_failure_has_code", "fx_usage", "event_id", "status <> 'failed' or failure_code <> ''"),
    Q.Check("usage_success_has_model", "fx_usage", "event_id", "status <> 'succeeded' or model <> ''"),
    Q.Check("usage_tokens_bounded", "fx_usage", "event_id", "total_tokens <= 90"),
    Q.Check("source_permission_domain", "fx_source", "candidate_id", "contact_permission <> 'unknown'"),
    Q.Unique("candidate_skill_unique", "fx_candidate_skill", ("candidate_id", "skill")),
    Q.Unique("import_reference_unique", "fx_import", ("org_id", "source_reference")),
    Q.Unique("requirement_position_unique", "fx_requirement_skill", ("requirements_id", "importance", "pos")),
    Q.Reference("source_candidate", "fx_source", "candidate_id", "fx_candidate", "candidate_id"),
    Q.Reference("assessment_candidate", "fx_assessment", "entry_id", "fx_pool", "candidate_id"),
]


def quality_rules(spark, sf_dir):
    names = {r.table for r in RULES} | {r.other for r in RULES if isinstance(r, Q.Reference)}
    return Q.run({n: view(spark, sf_dir, n) for n in names}, RULES)


def normalised_names(spark, sf_dir):
    return view(spark, sf_dir, "supplier").select("s_suppkey", N.taxonomy(F.concat(F.lit("  "), F.upper("s_name"), F.lit(" \t x "))).alias("name"), N.phone_key(F.concat(F.lit("+(0) "), F.col("s_suppkey").cast("string"), F.lit("-12345"))).alias("phone"))


def key_sql(columns) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({c} AS STRING)" for c in columns) + ")"


def rules_sql(rules: list) -> str:
    parts = []
    for r in rules:
        if isinstance(r, Q.Check):
            condition = re.sub(r"\bdate'", "DATE '", r.condition)
            parts.append(f"SELECT '{r.rule}' AS rule, CAST({r.key} AS STRING) AS key, count(*) AS count FROM {{{r.table}}} WHERE NOT ({condition}) GROUP BY 1, 2")
        elif isinstance(r, Q.Unique):
            parts.append(f"SELECT '{r.rule}', {key_sql(r.columns)}, count(*) FROM {{{r.table}}} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in r.columns)} GROUP BY {', '.join(r.columns)} HAVING count(*) > 1")
        else:
            own, other = ((c,) if isinstance(c, str) else c for c in (r.column, r.other_column))
            same = " AND ".join(f"o.{o} = t.{c}" for c, o in zip(own, other, strict=True))
            whole = " AND ".join(f"t.{c} IS NOT NULL" for c in own)
            parts.append(f"SELECT '{r.rule}', {key_sql([f't.{c}' for c in own])}, count(*) FROM {{{r.table}}} t WHERE {whole} AND NOT EXISTS (SELECT 1 FROM {{{r.other}}} o WHERE {same}) GROUP BY {', '.join(f't.{c}' for c in own)}")
    return " UNION ALL ".join(parts)


_SAID = """
said AS (SELECT conv_id, turn, conv_id % 23 AS n, concat(coalesce(text, ''), CASE WHEN turn % 2 = 0 THEN concat(' over ', CAST(conv_id % 23 AS STRING), ' years ') ELSE ' twelve months ' END,
  CASE WHEN conv_id % 23 % 3 = 0 THEN ' said "hello there" ' ELSE '' END, CASE WHEN conv_id % 23 % 5 = 0 THEN ' her nationality ' ELSE '' END) AS text FROM {conversations})"""

# every protected term, as the wording rule has it
_PROTECTED = (
    "(?i)\\b(age|aged|date\\s+of\\s+birth|dob|sex|gender|pregnan(t|cy)|sexual\\s+orientation|race|racial|ethnicity|ethnic|nationality|citizenship|"
    "religion|religious|political\\s+(view|views|belief|beliefs)|disability|disabled|health|medical\\s+(condition|conditions)|marital\\s+status|family\\s+status)\\b"
)
_CLAIM = "'(?i)\\b(?:[0-9]+|twelve)\\s*\\+?\\s*(?:years?|yrs?|months?|percent)\\b'"

_REFS = """
f AS (SELECT requirements_id AS k, location FROM {fx_requirements} WHERE requirements_id % 7 <> 0),
r AS (
  SELECT requirements_id AS k, 0 AS g, importance AS a, pos AS b, concat('skill:', skill) AS reference, skill AS label, importance AS category FROM {fx_requirement_skill} WHERE requirements_id % 7 <> 0
  UNION ALL SELECT k, 1, '', 0, 'field:minimum_experience', 'At least 4.5 years of experience', 'minimum_experience' FROM f WHERE k % 5 = 0
  UNION ALL SELECT k, 2, '', 0, 'field:location', location, 'location' FROM f UNION ALL SELECT k, 3, '', 0, 'field:work_mode', 'Remote', 'work_mode' FROM f WHERE k % 3 = 0
  UNION ALL SELECT k, 4, '', 0, 'field:employment_type', 'Full-time', 'employment_type' FROM f
  UNION ALL SELECT k, 10, '', 0, 'field:language:1', 'Latin', 'language' FROM f WHERE k % 4 = 1 UNION ALL SELECT k, 10, '', 1, 'field:language:2', location, 'language' FROM f WHERE k % 4 = 1
  UNION ALL SELECT k, 11, '', 0, 'field:education:1', 'MSc', 'education' FROM f WHERE k % 6 = 0
  UNION ALL SELECT requirements_id, 20, rule_type, 0, concat('rule:', rule_type), concat(CASE rule_type WHEN 'required_skill' THEN 'Required skill' WHEN 'minimum_experience' THEN 'Minimum years of experience' WHEN 'work_mode' THEN 'Work mode' WHEN 'employment_type' THEN 'Employment type'
      ELSE concat(upper(left(rule_type, 1)), substr(rule_type, 2)) END, ': ', CASE WHEN rule_type = 'minimum_experience' THEN concat('At least ', CAST(tenths // 10 AS STRING), ' years') ELSE expected END), concat('hard_constraint:', rule_type) FROM {fx_rule} WHERE requirements_id % 7 <> 0
  UNION ALL SELECT requirements_id, 30, '', 0, 'field:summary', 'about the job', 'summary' FROM {fx_requirements} WHERE requirements_id % 14 = 0),
refs AS (SELECT k AS requirements_id, CAST(row_number() OVER (PARTITION BY k ORDER BY g, a, b, reference, label) AS INT) AS ordinal, reference, label, category FROM r)"""

_KEYS = """
k AS (SELECT row_number, org_id, 0 AS kind, email AS key FROM {fx_import} UNION ALL SELECT row_number, org_id, 1, phone FROM {fx_import}
      UNION ALL SELECT row_number, org_id, 2, source_reference FROM {fx_import}),
p AS (SELECT candidate_id, org_id, 0 AS kind, email AS key FROM {fx_pool} UNION ALL SELECT candidate_id, org_id, 1, phone FROM {fx_pool} UNION ALL SELECT candidate_id, org_id, 2, source_reference FROM {fx_pool})"""


#: The rounds of "first for all its keys" as a recursion over open rows.
_TRIAGED = f"WITH RECURSIVE {_KEYS.strip()}," + """
open_ AS (SELECT * FROM k WHERE row_number % 11 <> 0 AND row_number NOT IN (SELECT k.row_number FROM k JOIN p ON p.org_id = k.org_id AND p.kind = k.kind AND p.key = k.key)),
r AS (
  SELECT row_number, org_id, kind, key, 'open' AS status FROM open_
  UNION ALL
  SELECT row_number, org_id, kind, key, CASE WHEN leads THEN 'created' WHEN bool_or(made) OVER (PARTITION BY row_number) THEN 'duplicate' ELSE 'open' END FROM (
    SELECT *, bool_or(leads) OVER (PARTITION BY org_id, kind, key) AS made FROM (
      SELECT *, bool_and(row_number = low) OVER (PARTITION BY row_number) AS leads FROM (
        SELECT *, min(row_number) OVER (PARTITION BY org_id, kind, key) AS low FROM r WHERE status = 'open')))),
triaged AS (SELECT i.org_id, i.row_number, CASE WHEN i.row_number % 11 = 0 THEN 'invalid' WHEN c.row_number IS NOT NULL THEN 'created' ELSE 'duplicate' END AS status
  FROM {fx_import} i LEFT JOIN (SELECT DISTINCT row_number FROM r WHERE status = 'created') c ON c.row_number = i.row_number)"""


def sql() -> dict[str, str]:
    rank = "round(sum(CASE WHEN rnk <= 5 THEN (pow(2, grade) - 1) / log2(rnk + 1) END) / sum(CASE WHEN i <= 5 THEN (pow(2, grade) - 1) / log2(i + 1) END), 4)"
    ranked = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM {fx_judgment})"
    return {
        "dup_documents": oracle("""
            SELECT org_id, document_id, first_id, copy FROM (SELECT org_id, document_id, min(document_id) OVER w AS first_id, row_number() OVER (PARTITION BY org_id, coalesce(text, '') ORDER BY document_id) - 1 AS copy
              FROM {fx_document} WHERE NOT is_deleted WINDOW w AS (PARTITION BY org_id, coalesce(text, ''))) WHERE copy > 0"""),
        "dup_identity": oracle("WITH " + _KEYS + """
            SELECT org_id, row_number, min(candidate_id) AS candidate_id, count(DISTINCT candidate_id) > 1 AS conflicting,
              concat_ws(', ', CASE WHEN bool_or(kind = 0) THEN 'email' END, CASE WHEN bool_or(kind = 1) THEN 'phone' END, CASE WHEN bool_or(kind = 2) THEN 'source reference' END) AS reasons
            FROM (SELECT k.org_id, k.row_number, k.kind, p.candidate_id FROM k JOIN p ON p.org_id = k.org_id AND p.kind = k.kind AND p.key = k.key) GROUP BY 1, 2"""),
        "csv_triage": oracle(_TRIAGED + " SELECT org_id, row_number, status FROM triaged"),
        "import_counts": oracle(_TRIAGED + """ SELECT org_id, count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'invalid') AS invalid,
            count(*) AS total FROM triaged GROUP BY 1"""),
        "meaningful_tokens": oracle(
            "WITH t AS (SELECT item_id, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS x FROM {benchmark}), k AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(x, '[\\p{L}\\p{M}\\p{N}_][\\p{L}\\p{M}\\p{N}_+#.]*[\\p{L}\\p{M}\\p{N}_]')) AS token FROM t)"
            " SELECT item_id, token FROM k WHERE NOT regexp_full_match(token, '[0-9]+') AND token NOT IN ('and', 'at', 'candidate', 'experience', 'for', 'has', 'have', 'least', 'must', 'of', 'required', 'requires', 'skill', 'the', 'with', 'year', 'years')"
        ),
        "batch_counts": oracle("""
            SELECT o_orderkey AS batch_id, CASE WHEN o_orderstatus = 'F' THEN 'cancelled' WHEN count(*) FILTER (status = 'queued') = 0 THEN 'completed' ELSE 'open' END AS batch_status,
              count(job_id) AS items, count(*) FILTER (status = 'queued') AS pending, count(*) FILTER (status = 'succeeded') AS created FROM {orders} LEFT JOIN {fx_task} ON job_id = o_orderkey GROUP BY o_orderkey, o_orderstatus"""),
        "skill_vocabulary": oracle("""
            SELECT DISTINCT CAST(l_orderkey % 5 AS INT) AS org_id, lower(concat(p_type, ' ', p_brand)) AS normalized_name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_orderkey % 5 <> 0"""),
        "document_delivery": oracle(r"""
            WITH n AS (SELECT *, trim(string_split(coalesce(original_filename, ''), '/')[-1]) AS f, strlen(coalesce(text, '')) AS size FROM {fx_registry}),
            m AS (SELECT *, CASE WHEN f <> '' AND length(f) <= 255 AND NOT contains(f, chr(7)) THEN f END AS filename FROM n)
            SELECT path, filename, CASE WHEN is_deleted OR candidate_status = 'deleted' OR extraction_status <> 'succeeded' THEN 'document_unavailable'
                WHEN document_type <> 'cv' OR content_type IS NULL OR content_type = 'text/plain' OR filename IS NULL THEN 'invalid_document_metadata'
                WHEN NOT stored THEN 'document_unavailable' WHEN size = 0 OR size > 10485760 OR size_error <> 0 OR hash_lost THEN 'document_integrity_failed' ELSE 'ok' END AS reason FROM m"""),
        "known_value_redaction": oracle(r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'), ' ') AS w FROM {documents}),
            v AS (SELECT doc_id, t, upper(coalesce(w[2], '')) AS a, trim(concat_ws(' ', coalesce(w[3], ''), coalesce(w[4], ''))) AS b, lower(coalesce(w[6], '')) AS c FROM d),
            r AS (SELECT doc_id, CASE WHEN a = '' THEN t ELSE regexp_replace(t, a, '[CONTACT REDACTED]', 'gi') END AS t, b, c FROM v),
            s AS (SELECT doc_id, CASE WHEN b = '' THEN t ELSE regexp_replace(t, b, '[CONTACT REDACTED]', 'gi') END AS t, c FROM r),
            x AS (SELECT doc_id, regexp_replace(t, 'redacted\]', '[CONTACT REDACTED]', 'gi') AS t, c FROM s),
            y AS (SELECT doc_id, CASE WHEN c = '' THEN t ELSE regexp_replace(t, c, '[CONTACT REDACTED]', 'gi') END AS t FROM x),
            z AS (SELECT doc_id, regexp_replace(t, 'act', '[CONTACT REDACTED]', 'gi') AS t FROM y)
            SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS redacted_sha256 FROM z"""),
        "email_redaction": oracle("SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[CONTACT REDACTED]', 'g')) AS redacted_sha256 FROM {documents}"),
        "claim_issues": oracle("WITH " + _SAID + """
            SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(text, '""" + _PROTECTED + """') THEN 'protected_attribute_language' END,
              CASE WHEN len(list_filter(regexp_extract_all(text, """ + _CLAIM + """), lambda m: regexp_replace(lower(m), '\\s+', ' ', 'g') NOT IN ('12 months', 'twelve months', '4 years', '4 year', '4 yrs'))) > 0 THEN 'unsupported_measured_claim' END,
              CASE WHEN len(list_filter(regexp_extract_all(lower(regexp_replace(text, '\\s+', ' ', 'g')), '"([^"]{2,200})"', 1), lambda q: NOT contains(CASE WHEN conv_id % 2 = 0 THEN '12 months and 4 years she said hello there to all' ELSE '12 months and 4 years nothing' END, trim(q)))) > 0
                THEN 'unsupported_quoted_claim' END) AS issues FROM said"""),
        "measured_claims": oracle(
            "WITH " + _SAID + ", f AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, " + _CLAIM + ")) AS m, generate_subscripts(regexp_extract_all(text, " + _CLAIM + "), 1) AS i FROM said)"
            ", c AS (SELECT conv_id, turn, i, concat(CASE WHEN lower(m) LIKE 'twelve%' THEN '12' ELSE CAST(CAST(regexp_extract(m, '[0-9]+') AS INT) AS STRING) END, CASE WHEN regexp_matches(m, '(?i)y(ears?|rs?)$') THEN ' years' WHEN regexp_matches(m, '(?i)months?$') THEN ' months' ELSE ' percent' END) AS claim FROM f)"
            " SELECT s.conv_id, s.turn, coalesce(string_agg(claim, '|' ORDER BY i), '') AS claims FROM said s LEFT JOIN c ON c.conv_id = s.conv_id AND c.turn = s.turn GROUP BY 1, 2"
        ),
        "protected_language": oracle("WITH " + _SAID + " SELECT conv_id, turn, regexp_matches(text, '" + _PROTECTED + "') AS protected FROM said"),
        "requirement_refs": oracle("WITH " + _REFS + " SELECT requirements_id, ordinal, reference, label, category FROM refs"),
        "requirement_bounds": oracle("WITH " + _REFS + """, n AS (SELECT requirements_id, count(*) AS n FROM refs GROUP BY 1)
            SELECT r.requirements_id, CASE WHEN n IS NULL THEN 'no_requirements' ELSE 'too_many_requirements' END AS issue FROM {fx_requirements} r LEFT JOIN n ON n.requirements_id = r.requirements_id WHERE n IS NULL OR n > 8"""),
        "evidence_refs": oracle("""
            WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, string_split(coalesce(text, ''), ' ') AS w FROM {conversations}),
            s AS (SELECT conv_id, n, array_to_string(w[1:2], ' ') AS name, CASE WHEN turn % 2 = 0 THEN array_to_string(w[1:4], ' ') ELSE array_to_string(w[2:4], ' ') END AS evidence FROM c),
            p AS (SELECT DISTINCT conv_id FROM {conversations}),
            r AS (
              SELECT conv_id, 0 AS g, 0 AS n, 'profile:summary' AS reference, 'short' AS label, 'shown' AS evidence FROM p WHERE conv_id % 6 = 0
              UNION ALL SELECT conv_id, 1, n, concat('profile:skill:', CAST(n AS STRING)), concat(name, CASE WHEN n % 2 = 0 THEN ' (2.5 years)' ELSE '' END), evidence FROM s
              UNION ALL SELECT conv_id, 12, 0, 'profile:availability', 'now', 'said so' FROM p
              UNION ALL SELECT conv_id, 13, 0, 'profile:employment_type:1', 'full-time', 'asked' FROM p WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, 13, 1, 'profile:employment_type:2', 'contract', 'asked' FROM p WHERE conv_id % 2 = 0)
            SELECT conv_id AS profile_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g, n) AS INT) AS ordinal, reference, label, evidence FROM r"""),
        "reference_issues": oracle("""
            WITH f AS (SELECT l_orderkey AS a, CAST(l_linenumber % 5 AS STRING) AS r, CASE WHEN l_tax < 0.02 THEN 'gap' ELSE 'match' END AS c, l_quantity > 5 AS cites, CAST(l_partkey % 4 AS STRING) AS e FROM {lineitem}),
            q AS (SELECT o_orderkey AS a, r FROM {orders} CROSS JOIN (SELECT '1' AS r UNION ALL SELECT '2' UNION ALL SELECT '3') x)
            SELECT a AS assessment_id, 'requirement_not_assessed' AS issue, r AS reference FROM q WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.a = q.a AND f.r = q.r)
            UNION ALL SELECT DISTINCT a, 'unknown_requirement', r FROM f WHERE r NOT IN ('1', '2', '3') UNION ALL SELECT DISTINCT a, 'unknown_evidence', e FROM f WHERE cites AND e = '3'
            UNION ALL SELECT a, 'requirement_repeated', r FROM f GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL SELECT a, 'evidence_required', r FROM f WHERE NOT cites"""),
        "ndcg_at5": oracle(f"SELECT query_id, CAST({rank} AS DECIMAL(6,4)) AS ndcg, CAST(round(count(*) FILTER (rnk <= 5 AND grade >= 2) / 5.0, 4) AS DECIMAL(6,4)) AS precision FROM {ranked} GROUP BY 1"),
        "ndcg_macro": oracle(f"""
            SELECT CAST(round(avg(CAST(ndcg AS DOUBLE)), 4) AS DECIMAL(6,4)) AS ndcg, CAST(round(avg(CAST(precision AS DOUBLE)), 4) AS DECIMAL(6,4)) AS precision, count(*) AS queries
            FROM (SELECT query_id, CAST({rank} AS DECIMAL(6,4)) AS ndcg, CAST(round(count(*) FILTER (rnk <= 5 AND grade >= 2) / 5.0, 4) AS DECIMAL(6,4)) AS precision FROM {ranked} GROUP BY 1)"""),
        "overlap_at5": oracle("SELECT query_id, CAST(count(*) FILTER (rnk <= 5 AND rnk % 2 = 1) / 5.0 AS DECIMAL(6,4)) AS overlap FROM {fx_judgment} GROUP BY 1"),
        "coverage_gate": oracle("""
            WITH x AS (SELECT entry_id * 97 + version AS entry_id, score FROM {fx_assessment}), g AS (SELECT *, entry_id % 10 AS query_id, count(*) FILTER (entry_id % 50 = 3) OVER (PARTITION BY entry_id % 10) = 0 AS fine FROM x)
            SELECT query_id, entry_id, CASE WHEN fine THEN row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) END AS rnk, CASE WHEN fine THEN 'available' ELSE 'unavailable' END AS gate FROM g"""),
        "binding_issues": oracle("""
            WITH b AS (SELECT o_custkey + CASE WHEN o_orderkey % 16 = 0 THEN 100000000 ELSE 0 END AS code, count(*) AS n FROM {orders} GROUP BY 1)
            SELECT * FROM (SELECT coalesce(c_custkey, code) AS code, CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END AS issue FROM {customer} FULL JOIN b ON code = c_custkey) WHERE issue IS NOT NULL"""),
        "ranking_differences": oracle("SELECT query_id, rnk FROM {fx_judgment} WHERE rnk % 9 = 0 OR rnk % 5 = 0"),
        "quality_rules": oracle(rules_sql(RULES)),
        "normalised_names": oracle("SELECT s_suppkey, lower(concat(s_name, ' x')) AS name, CASE WHEN length(concat('0', CAST(s_suppkey AS STRING), '12345')) >= 7 THEN concat('0', CAST(s_suppkey AS STRING), '12345') ELSE '' END AS phone FROM {supplier}"),
        "email_counts": oracle("""
            WITH e AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS y FROM {documents})
            SELECT doc_id, CAST(len(x) AS INT) AS n_emails, coalesce(y[1], '') AS first_email FROM e"""),
        "context_sizes": oracle("""
            SELECT conv_id, turn, CAST(length(concat('{"conv_id":', CAST(conv_id AS STRING), ',"turn":', CAST(turn AS STRING), CASE WHEN text IS NULL THEN '}' ELSE concat(',"text":"', text, '"}') END)) AS INT) AS context_chars,
              length(concat('{"conv_id":', CAST(conv_id AS STRING), ',"turn":', CAST(turn AS STRING), CASE WHEN text IS NULL THEN '}' ELSE concat(',"text":"', text, '"}') END)) <= 600 AS fits FROM {conversations}"""),
    }


QUERIES = (
    dup_documents, dup_identity, csv_triage, import_counts, batch_counts, skill_vocabulary, identity_flags, email_counts, redaction_counts, known_value_redaction, document_delivery, email_redaction, claim_issues, measured_claims, protected_language,
    meaningful_tokens, grounding_issues, requirement_refs, requirement_bounds, evidence_refs, reference_issues, context_sizes, ndcg_at5, ndcg_macro, overlap_at5, coverage_gate, binding_issues, ranking_differences, quality_rules, normalised_names,
)
