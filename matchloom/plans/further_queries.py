"""Queries of gates, extraction checks, outreach contexts, staged intake, ledger rules, hashes and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.lineage import checkpoint_dir
from ..operators import grounding as G
from ..operators import intake as I
from ..operators import constraints as C
from ..operators import quality_rules as Q
from ..operators import ranking_eval as L
from ..operators import review as R
from ..operators import scoring as S
from ..operators import text_safety as X
from ..operators import versions as V
from ..sources import files, sinks
from .fixtures import oracle, view
from .matching_queries import _ALL, _POINTS, _RANKED, _inputs, _over, told
from .text_queries import rules_sql


def findings_outcomes(spark, sf_dir):
    """Line items as findings, by outcome in the order of their requirement."""
    t = view(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "gap").when(F.col("l_returnflag") == "R", "match").otherwise("uncertain")
    rows = t.select(F.col("l_orderkey").alias("assessment_id"), F.col("l_linenumber").alias("requirement_id"), kind.alias("category"), F.col("l_linestatus").alias("explanation"))
    wanted = t.filter("l_quantity > 3").select(F.col("l_orderkey").alias("assessment_id"), F.col("l_linenumber").alias("requirement_id"), (10 - F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("need "), F.col("l_linenumber").cast("string")).alias("label")).distinct()
    show = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.coalesce(x["ordinal"].cast("string"), F.lit("?")), F.coalesce(x["label"], F.lit("?")), x["explanation"])), ",")
    return G.findings_by_outcome(rows, wanted).select("assessment_id", *[show(c).alias(f"n_{c}") for c in ("match", "gap", "uncertain")])


def outreach_contexts(spark, sf_dir):
    """Chats as decisions; roles and first words as requirements, sentences as evidence."""
    c = view(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    finding = F.struct(F.concat(F.lit(" "), F.when(F.col("turn") % 5 == 4, "").otherwise(F.substring(text, 1, 400)), F.lit(" ")).alias("requirement_label"), F.transform(F.split(text, r"\."), lambda s: F.struct(s.alias("evidence"))).alias("candidate_evidence"))
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", finding.alias("f")))), lambda x: x["f"]).alias("findings"))
    done = G.outreach_context(rows.select(F.col("conv_id").alias("decision_id"), F.lit("Élan & Co").alias("organization_name"), F.concat(F.lit(" Post "), F.col("conv_id").cast("string")).alias("vacancy_title"), "findings"), limit=2000)
    joined = F.array_join(F.flatten(F.transform("facts", lambda f: F.concat(F.array(f["vacancy_requirement"]), f["candidate_evidence"]))), "|")
    return done.select("decision_id", F.size("facts").alias("n_facts"), F.sha2(joined.cast("binary"), 256).alias("facts_sha256"), "context_chars", "fits")


def extraction_checks(spark, sf_dir):
    """Suppliers as extracted profiles, some empty, some without evidence, some with repeats."""
    s, k = view(spark, sf_dir, "supplier"), F.col("s_suppkey")
    skill = lambda name, proof: F.struct(name.alias("name"), proof.alias("evidence"))
    proof = F.when(F.length("s_name") + k % 4 == F.length("s_name"), "").otherwise("seen")
    skills = F.when(k % 3 == 0, F.array().cast("array<struct<name:string,evidence:string>>")).otherwise(F.array(skill(F.col("s_name"), F.lit("x")), skill(F.when(k % 5 == 0, F.lower("s_name")).otherwise("other"), proof)))
    rows = s.select(k.alias("profile_id"), skills.alias("skills"), F.when(k % 7 == 0, "Rome").otherwise("").alias("location"), F.when(k % 14 == 0, "lives there").otherwise("").alias("location_evidence"), F.when(k % 9 == 0, F.array(F.lit("Unclear"), F.lit("unclear"))).otherwise(F.array().cast("array<string>")).alias("ambiguities"))
    return G.extraction_issues(rows).select("profile_id", F.concat_ws(",", "issues").alias("issues"))


def cleared_payloads(spark, sf_dir):
    """Orders as staged items; what is no longer pending loses its private fields."""
    o = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("created").alias("status"), F.col("o_orderpriority").alias("full_name"), F.concat(F.col("o_orderkey").cast("string"), F.lit("@x.org")).alias("email"), "o_custkey")
    return I.clear_payload(o)


def staged_reviews(spark, sf_dir):
    """Imported rows as staged items, by batch with their position, duplicates and labels."""
    rows = view(spark, sf_dir, "fx_import")
    n = F.col("row_number")
    items = rows.select(n.alias("item_id"), F.expr("row_number div 40").alias("batch_id"), "org_id", "email", "phone", "source_reference", F.when(n % 3 == 0, "created").otherwise("pending").alias("status"), F.array(F.when(n % 2 == 0, "email_missing").otherwise("odd_flag")).alias("review_flags"))
    return I.review_rows(items, view(spark, sf_dir, "fx_pool")).select("org_id", "batch_id", "item_id", "position", "candidate_id", "conflicting", "match_reasons", F.concat_ws(",", "flag_labels").alias("labels"))


def dataset_identities(spark, sf_dir):
    """A region and its nations as a dataset; names are sorted at every level."""
    n = view(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    r = view(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    nations = F.transform("x", lambda x: F.struct(x["n_nationkey"].alias("key"), x["n_name"].alias("code")))
    judged = F.map_from_entries(F.reverse(F.transform("x", lambda x: F.struct(x["n_name"].alias("key"), (x["n_nationkey"] % 4).alias("value")))))  # against the order of keys
    return L.dataset_identity(r.select(F.struct(F.col("r_name").alias("title"), nations.alias("candidates"), judged.alias("judgments")).alias("body"), F.col("r_regionkey").alias("dataset_id")))


def canonical_hashes(spark, sf_dir):
    """H1: three fields of each order."""
    o = view(spark, sf_dir, "orders")
    return o.select("o_orderkey", N.canonical_hash(F.col("o_custkey").alias("a"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("b"), F.col("o_orderpriority").alias("c")).alias("hash"))


def decision_language(spark, sf_dir):
    """Turns that tell what to do with a candidate, phrases put into some."""
    c = view(spark, sf_dir, "conversations")
    phrase = F.when(F.col("conv_id") % 3 == 0, " We Recommend   hiring now").when(F.col("conv_id") % 3 == 1, " they should be glad").otherwise(" you should\ncontact them")
    return c.select("conv_id", "turn", X.decision_language(F.concat(F.coalesce("text", F.lit("")), phrase)).alias("decides"))


def display_names(spark, sf_dir):
    """Names with odd spacing, shown tidily and cut."""
    c = view(spark, sf_dir, "customer")
    odd = F.concat(F.lit("\t  "), F.col("c_name"), F.lit(" \n "), F.col("c_mktsegment"), F.lit("  "))
    return c.select("c_custkey", N.display(odd).alias("shown"), N.bounded(odd, 12).alias("cut"))


def extracted_texts(spark, sf_dir):
    """Documents with carriage returns, trailing blanks and nulls put in."""
    d = view(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 50 == 0, " \r\n\t").otherwise(F.concat(F.lit(" \n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" \t\r\n")), F.lit("\u0000 \r")))
    x = N.extracted_text(raw)
    return d.select("doc_id", F.sha2(x["text"].cast("binary"), 256).alias("sha256"), x["error"].alias("error"))


def outreach_gates(spark, sf_dir):
    """V5-V7: orders as drafts on decisions on assessments."""
    o, k = view(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        k.alias("draft_id"), F.when(k % 13 == 0, "deleted").otherwise("active").alias("candidate_status"), (k % 17 == 0).alias("vacancy_deleted"), (k % 3 != 0).alias("is_latest"), (k % 4).alias("profile_id"), F.when(k % 19 == 0, -1).otherwise(k % 4).alias("current_profile_id"),
        (k % 23 == 0).alias("is_stale"), (k % 5 != 0).alias("is_latest_decision"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("approved").alias("decision"), (k % 7 != 0).alias("is_latest_draft"), (k % 2 == 0).alias("approved"),
        F.when(F.col("o_custkey") % 6 == 0, "permission_restricted").otherwise("ok").alias("contact_gate"),
    )
    return V.outreach_eligibility(V.decision_eligibility(rows)).select("draft_id", "decision_gate", "draft_gate", "approve_gate", "action_gate")


def requirement_sync(spark, sf_dir):
    """Two lists of part types and brands of each order, with repeats in other case."""
    t = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = t.groupBy(F.col("l_orderkey").alias("requirements_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.upper("p_brand").alias("x")))), lambda x: x["x"]).alias("must"),
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("x")))), lambda x: x["x"]).alias("nice"),
    )
    return I.sync_requirement_skills(lists).select("requirements_id", "importance", "pos", "normalized_name")


def published_skills(spark, sf_dir):
    """Skills that a document adds to what its candidate holds."""
    t = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))
    profiles = t.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.struct(name.alias("name"), F.col("p_type").alias("evidence")).alias("s")))), lambda x: x["s"]).alias("skills"))
    profiles = profiles.withColumn("candidate_id", F.col("document_id"))
    held = t.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("candidate_id"), (F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("document_id"), F.lower("p_brand").alias("normalized_name"))
    gone, added = I.publish_skills(profiles, held)
    add = added.select("candidate_id", "normalized_name", F.lit("added").alias("change"))
    return add.unionByName(gone.select("candidate_id", "normalized_name", F.lit("removed").alias("change")))


def structured_requirements(spark, sf_dir):
    """Orders with any structured field, in two columns."""
    o = view(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("title"), F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")).alias("listed"), F.when(F.col("o_custkey") % 5 == 0, F.lit(1.5)).alias("years"))
    flagged = rows.withColumn("structured", R.has_requirements({"title": "text", "listed": "array", "years": "number"}))
    return R.minimised(flagged, ("o_orderkey", "structured"))


def import_validation(spark, sf_dir):
    """Customers as rows of an import, with faults put into some."""
    c, k = view(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(
        k.alias("row_number"), F.when(k % 5 == 0, " \t").otherwise(F.col("c_name")).alias("full_name"), F.when(k % 3 == 0, "no at sign").when(k % 3 == 1, F.concat(F.lit(" a"), k.cast("string"), F.lit("@b.org "))).otherwise("").alias("email"),
        F.when(k % 11 == 0, F.repeat(F.lit("1"), 51)).otherwise("").alias("phone"), F.col("c_mktsegment").alias("location"), F.lit(None).cast("string").alias("source_reference"), F.when(k % 7 == 0, "2024-02-30").when(k % 7 == 1, "2024-02-29").otherwise("").alias("retention_until"),
    )
    return I.validate(rows).select("row_number", F.concat_ws(",", "reasons").alias("reasons"))


def decoded_props(spark, sf_dir):
    """A JSON column, made unreadable for some rows."""
    e = view(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 9 == 1, "{").otherwise(F.col("props"))
    x = files.decode_json(text, "struct<k:int>")
    return e.select("event_id", F.when(x["error"].isNull(), x["value"]["k"]).alias("k"), x["error"].alias("error"))


def typed_nations(spark, sf_dir):
    """A table read with its declared schema."""
    return files.typed(spark, f"{sf_dir}/nation.parquet", "n_nationkey int, n_name string").select("n_nationkey", "n_name")


def review_totals(spark, sf_dir):
    """G10 over the reviews of line items."""
    from .more_queries import finding_review

    expected = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("assessment_id"))
    return G.review_report(G.assessment_review(finding_review(spark, sf_dir), expected))


def stored_shortlists(spark, sf_dir):
    """Runs and entries written as two tables by organisation and read again."""
    req, wanted, rules, cands, skills = _inputs(spark, sf_dir)
    more = told(spark, sf_dir)
    orgs = req.select(F.col("requirements_id").alias("run_id"), "org_id")
    runs = S.run_summary(S.filter_report(req, rules, cands, skills, **more)).withColumnRenamed("requirements_id", "run_id").join(orgs, "run_id")
    entries = S.shortlist(req, wanted, rules, cands, skills, **more).withColumnRenamed("requirements_id", "run_id").join(orgs, "run_id")
    path = f"{checkpoint_dir(spark)}/shortlists-{uuid.uuid4().hex}"
    for _ in range(2):  # the second time stores nothing
        sinks.append_shortlists(runs, entries, path, batch="first")
    n = sinks.read_committed(spark, path, "entries").groupBy("run_id").agg(F.count("*").alias("stored"), F.sum("score_cents").alias("cents"))
    return sinks.read_committed(spark, path, "runs").join(n, "run_id", "left").select("run_id", "org_id", "evaluated", "eligible", "shortlisted", F.coalesce("stored", F.lit(0)).alias("stored"), "cents")


#: The view that stands for each table of the constraints.
RULE_VIEWS = {"match_run": "fx_run", "shortlist_entry": "fx_entry", "audit_event": "fx_audit", "ai_usage_event": "fx_attempt", "candidate": "fx_person", "assessment": "fx_assessment", "background_task": "fx_task", "vacancy": "fx_vacancy", "membership": "fx_member", "organization": "fx_organization", "candidate_source": "fx_source", "candidate_skill": "fx_candidate_skill_full", "requirement_skill": "fx_requirement_skill", "vacancy_requirements": "fx_requirement_version", "candidate_document": "fx_document"}


def ledger_rules(spark, sf_dir):
    return Q.run({n: view(spark, sf_dir, v) for n, v in RULE_VIEWS.items()}, C.RULES)


def _gate(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{code}'" for c, code in pairs) + " ELSE 'ok' END"


def sql() -> dict[str, str]:
    decision = _gate([("k % 13 = 0", "candidate_inactive"), ("k % 17 = 0", "vacancy_deleted"), ("k % 3 = 0", "not_latest_assessment"), ("k % 19 = 0", "profile_changed"), ("k % 23 = 0", "inputs_changed")])
    return {
        "findings_outcomes": oracle("""
            WITH w AS (SELECT DISTINCT l_orderkey, l_linenumber, 10 - l_linenumber AS o, concat('need ', CAST(l_linenumber AS STRING)) AS label FROM {lineitem} WHERE l_quantity > 3),
            f AS (SELECT l.l_orderkey AS a, l.l_linenumber AS r, l_returnflag AS c, o, label, l_linestatus AS e FROM {lineitem} l LEFT JOIN w ON w.l_orderkey = l.l_orderkey AND w.l_linenumber = l.l_linenumber),
            x AS (SELECT *, concat_ws(':', coalesce(CAST(o AS STRING), '?'), coalesce(label, '?'), e) AS s FROM f)
            SELECT a AS assessment_id, coalesce(string_agg(s, ',' ORDER BY o NULLS FIRST, r, label, e) FILTER (c = 'R'), '') AS n_match, coalesce(string_agg(s, ',' ORDER BY o NULLS FIRST, r, label, e) FILTER (c = 'A'), '') AS n_gap,
              coalesce(string_agg(s, ',' ORDER BY o NULLS FIRST, r, label, e) FILTER (c NOT IN ('R', 'A')), '') AS n_uncertain FROM x GROUP BY 1"""),
        "outreach_contexts": oracle("""
            WITH t AS (SELECT conv_id, turn, trim(CASE WHEN turn % 5 = 4 THEN '' ELSE left(coalesce(text, ''), 400) END, chr(32) || chr(9) || chr(10) || chr(13)) AS label, string_split(coalesce(text, ''), '.')[1:3] AS parts, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {conversations}),
            l AS (SELECT conv_id, turn, left(label, 300) AS label, list_filter(list_transform(parts, lambda x: left(trim(x, chr(32) || chr(9) || chr(10) || chr(13)), 500)), lambda x: x <> '') AS ev FROM t WHERE n <= 8),
            g AS (SELECT * FROM l WHERE label <> '' AND len(ev) > 0),
            j AS (SELECT conv_id, count(*) AS m, string_agg(label || '|' || array_to_string(ev, '|'), '|' ORDER BY turn) AS joined, sum(len(ev) + 2) AS inner_blanks,
                    string_agg('{"candidate_evidence":' || CAST(to_json(ev) AS STRING) || ',"vacancy_requirement":' || CAST(to_json(label) AS STRING) || '}', ',' ORDER BY turn) AS body FROM g GROUP BY 1),
            w AS (SELECT c.conv_id, coalesce(m, 0) AS m, coalesce(joined, '') AS joined, coalesce(inner_blanks, 0) AS inner_blanks,
                    concat('{"approved_match_facts":[', coalesce(body, ''), '],"candidate_name_placeholder":"[Candidate name]","organization_name":"Élan & Co","schema_version":"outreach_draft.v1","vacancy_title":"Post ', CAST(c.conv_id AS STRING), '"}') AS context
                  FROM (SELECT DISTINCT conv_id FROM {conversations}) c LEFT JOIN j ON j.conv_id = c.conv_id),
            s AS (SELECT *, length(context) + 5 * length(regexp_replace(context, '[\\x00-\\x7F]', '', 'g')) + 9 + greatest(m - 1, 0) + inner_blanks AS size FROM w)
            SELECT conv_id AS decision_id, CAST(m AS INT) AS n_facts, sha256(joined) AS facts_sha256, CAST(size AS INT) AS context_chars, size <= 2000 AS fits FROM s"""),
        "extraction_checks": oracle("""
            SELECT s_suppkey AS profile_id, concat_ws(',', CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0 THEN 'no_facts' END,
              CASE WHEN (s_suppkey % 3 <> 0 AND s_suppkey % 4 = 0) OR (s_suppkey % 7 = 0 AND s_suppkey % 14 <> 0) THEN 'evidence_required' END,
              CASE WHEN s_suppkey % 3 <> 0 AND lower(s_name) = lower(CASE WHEN s_suppkey % 5 = 0 THEN lower(s_name) ELSE 'other' END) THEN 'skills_repeat' END, CASE WHEN s_suppkey % 9 = 0 THEN 'ambiguities_repeat' END) AS issues FROM {supplier}"""),
        "cleared_payloads": oracle("""
            SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'created' END AS status, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END AS full_name,
              CASE WHEN o_orderstatus = 'O' THEN concat(CAST(o_orderkey AS STRING), '@x.org') ELSE '' END AS email, o_custkey FROM {orders}"""),
        "staged_reviews": oracle("""
            WITH i AS (SELECT *, row_number // 40 AS batch_id FROM {fx_import} WHERE row_number % 3 <> 0),
            k AS (SELECT row_number, org_id, 0 AS kind, email AS key FROM i UNION ALL SELECT row_number, org_id, 1, phone FROM i UNION ALL SELECT row_number, org_id, 2, source_reference FROM i),
            p AS (SELECT candidate_id, org_id, 0 AS kind, email AS key FROM {fx_pool} UNION ALL SELECT candidate_id, org_id, 1, phone FROM {fx_pool} UNION ALL SELECT candidate_id, org_id, 2, source_reference FROM {fx_pool}),
            m AS (SELECT k.org_id, k.row_number, min(candidate_id) AS candidate_id, count(DISTINCT candidate_id) > 1 AS conflicting,
                    concat_ws(', ', CASE WHEN bool_or(k.kind = 0) THEN 'email' END, CASE WHEN bool_or(k.kind = 1) THEN 'phone' END, CASE WHEN bool_or(k.kind = 2) THEN 'source reference' END) AS reasons
                  FROM k JOIN p ON p.org_id = k.org_id AND p.kind = k.kind AND p.key = k.key GROUP BY 1, 2)
            SELECT i.org_id, batch_id, i.row_number AS item_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY i.row_number) AS INT) AS position, candidate_id, coalesce(conflicting, false) AS conflicting, coalesce(reasons, '') AS match_reasons,
              CASE WHEN i.row_number % 2 = 0 THEN 'Email not found' ELSE 'Needs review' END AS labels FROM i LEFT JOIN m ON m.org_id = i.org_id AND m.row_number = i.row_number"""),
        "dataset_identities": oracle("""
            SELECT r_regionkey AS dataset_id, sha256(concat('{"body":{"candidates":[', string_agg(concat('{"code":"', n_name, '","key":', CAST(n_nationkey AS STRING), '}'), ',' ORDER BY n_nationkey), '],"judgments":{', string_agg(concat('"', n_name, '":', CAST(n_nationkey % 4 AS STRING)), ',' ORDER BY n_name), '},"title":"', r_name, '"},"dataset_id":', CAST(r_regionkey AS STRING), '}')) AS identity
            FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name"""),
        "canonical_hashes": oracle("""
            SELECT o_orderkey, sha256(concat('{"a":', CAST(o_custkey AS STRING), ',"b":', CASE WHEN o_orderstatus <> 'F' THEN concat('"', o_orderstatus, '"') ELSE 'null' END, ',"c":"', o_orderpriority, '"}')) AS hash FROM {orders}"""),
        "decision_language": oracle("""
            SELECT conv_id, turn, regexp_matches(concat(coalesce(text, ''), CASE conv_id % 3 WHEN 0 THEN ' We Recommend   hiring now' WHEN 1 THEN ' they should be glad' ELSE concat(' you should', chr(10), 'contact them') END),
              '(?i)\\b(should|recommend(ed|s)?)\\s+(hir(e|ing)|reject|approve|contact|outreach)\\b') AS decides FROM {conversations}"""),
        "display_names": oracle("SELECT c_custkey, concat(c_name, ' ', c_mktsegment) AS shown, left(concat(c_name, ' ', chr(10), ' ', c_mktsegment), 12) AS cut FROM {customer}"),
        "extracted_texts": oracle("""
            WITH x AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') END AS t FROM {documents})
            SELECT doc_id, sha256(t) AS sha256, CASE WHEN t = '' THEN 'empty_text' END AS error FROM x"""),
        "outreach_gates": oracle("""
            WITH d AS (SELECT o_orderkey AS k, """ + decision + """ AS decision_gate, o_orderstatus AS s, o_custkey % 6 = 0 AS blocked FROM {orders}),
            e AS (SELECT *, """ + _gate([("k % 5 = 0", "not_latest_decision"), ("s = 'P'", "not_approved"), ("decision_gate <> 'ok'", "decision_outdated")]) + """ AS draft_gate FROM d)
            SELECT k AS draft_id, decision_gate, draft_gate, """ + _gate([("k % 7 = 0", "not_latest_draft"), ("draft_gate <> 'ok'", "draft_outdated"), ("k % 2 = 0", "already_approved"), ("blocked", "contact_blocked")])
            + " AS approve_gate, " + _gate([("k % 7 = 0", "not_latest_draft"), ("k % 2 <> 0", "not_approved"), ("draft_gate <> 'ok'", "draft_outdated"), ("blocked", "contact_blocked")]) + " AS action_gate FROM e"),
        "requirement_sync": oracle("""
            WITH t AS (SELECT l_orderkey AS r, l_linenumber AS n, lower(p_brand) AS brand, lower(p_type) AS kind FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
            a AS (SELECT r, 'must_have' AS importance, n, brand AS x, brand AS tie FROM t UNION ALL SELECT r, 'nice_to_have', n, CASE WHEN n % 2 = 0 THEN brand ELSE kind END, CASE WHEN n % 2 = 0 THEN brand ELSE kind END FROM t),
            f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY r, x ORDER BY importance, n) = 1)
            SELECT r AS requirements_id, importance, CAST(row_number() OVER (PARTITION BY r, importance ORDER BY n, tie) AS INT) AS pos, x AS normalized_name FROM f"""),
        "published_skills": oracle("""
            WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n, lower(p_brand) AS x FROM {lineitem} JOIN {part} ON l_partkey = p_partkey), kept AS (SELECT k, x FROM t WHERE n = 2)
            SELECT DISTINCT k AS candidate_id, x AS normalized_name, 'added' AS change FROM t WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.k = t.k AND kept.x = t.x)
            UNION ALL SELECT k, x, 'removed' FROM t WHERE n = 1"""),
        "structured_requirements": oracle("SELECT o_orderkey, o_orderkey % 2 <> 0 OR o_orderkey % 3 <> 0 OR o_custkey % 5 = 0 AS structured FROM {orders}"),
        "import_validation": oracle("""
            SELECT c_custkey AS row_number, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'full_name_required' END, CASE WHEN c_custkey % 11 = 0 THEN 'phone_too_long' END, CASE WHEN c_custkey % 3 = 0 THEN 'email_invalid' END,
              CASE WHEN c_custkey % 7 = 0 THEN 'retention_until_invalid' END) AS reasons FROM {customer}"""),
        "decoded_props": oracle("""
            SELECT event_id, CASE WHEN event_id % 9 > 1 AND json_valid(props) THEN CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 9 > 1 THEN NULL ELSE 'not_decodable' END AS error FROM {events}"""),
        "typed_nations": oracle("SELECT n_nationkey, n_name FROM {nation}"),
        "review_totals": oracle("""
            WITH f AS (SELECT l_orderkey AS a, max(CASE WHEN l_suppkey % 4 = 0 OR l_quantity < 5 OR l_quantity > 40 OR (l_returnflag <> 'A' AND l_partkey % 5 = 0) THEN 1 ELSE 0 END) AS bad FROM {lineitem} GROUP BY 1)
            SELECT count(*) AS expected, count(bad) AS reviewed, count(*) FILTER (bad = 0) AS clean, count(*) FILTER (bad = 1) AS flagged, count(bad) = count(*) AS complete, count(bad) = count(*) AND count(*) FILTER (bad = 1) = 0 AS passing FROM {orders} LEFT JOIN f ON a = o_orderkey"""),
        "stored_shortlists": _over(f"WITH {_POINTS}, {_ALL}, {_RANKED}" + """,
            o AS (SELECT requirements_id, count(*) AS evaluated, count(*) FILTER (outcome <> 'failed') AS eligible FROM outcomes GROUP BY 1), e AS (SELECT requirements_id, count(*) AS stored, sum(score_cents) AS cents FROM ranked WHERE rank <= 20 GROUP BY 1)
            SELECT r.requirements_id AS run_id, r.org_id, coalesce(evaluated, 0) AS evaluated, coalesce(eligible, 0) AS eligible, least(coalesce(eligible, 0), 20) AS shortlisted, coalesce(stored, 0) AS stored, CAST(cents AS BIGINT) AS cents
            FROM {fx_requirements} r LEFT JOIN o ON o.requirements_id = r.requirements_id LEFT JOIN e ON e.requirements_id = r.requirements_id WHERE r.status = 'confirmed' AND NOT vacancy_deleted"""),
        "ledger_rules": oracle(rules_sql([r._replace(table=RULE_VIEWS[r.table], **({"other": RULE_VIEWS[r.other]} if isinstance(r, Q.Reference) else {})) for r in C.RULES])),
    }


QUERIES = (
    findings_outcomes, outreach_contexts, extraction_checks, cleared_payloads, staged_reviews, dataset_identities, canonical_hashes, decision_language, display_names, extracted_texts, outreach_gates, requirement_sync,
    published_skills, structured_requirements, import_validation, decoded_props, typed_nations, review_totals, stored_shortlists, ledger_rules,
)
