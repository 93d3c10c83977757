"""References, evidence grounding and explanation review (G)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import bounded, evidence_key, explanation, fact_key, fold, is_ascii, strip
from . import text_safety as X
from .scoring import RULE_LABELS, expected_value

SCHEMA_VERSION = "outreach_draft.v1"  # fixed value
# fact columns of each nested group, with the label that issues carry
GROUPS = (
    ("skills", "skill item", (("name", ""),)),
    ("employment", "employment-history item", (("job_title", " job title"), ("employer", " employer"), ("period", " period"))),
    ("languages", "language item", (("language", ""), ("proficiency", " proficiency"))),
    ("education", "education item", (("qualification", " qualification"), ("institution", " institution"))),
    ("certifications", "certification item", (("name", ""), ("issuer", " issuer"))),
)
SCALARS = (("summary", "relevant-experience summary", False), ("location", "location", True), ("work_mode", "work-mode preference", True), ("availability", "availability", True))


def profile_claims(profiles: DataFrame) -> DataFrame:
    """profile_id, ord, label, fact (null: evidence alone), evidence: everything that a profile says it can show."""
    parts, n = [], 0
    for column, label, facts in GROUPS:
        rows = profiles.select("profile_id", F.posexplode(column).alias("pos", "x"))
        number = (F.col("pos") + 1).cast("string")
        base = rows.select("profile_id", (F.col("pos") + n * 1000).alias("ord"), F.concat(F.lit(f"{label} "), number).alias("label"), F.lit(None).cast("string").alias("fact"), F.col("x.evidence").alias("evidence"))
        parts.append(base)
        for i, (field, tail) in enumerate(facts, 1):
            parts.append(rows.select("profile_id", (F.col("pos") + (100 + n * 10 + i) * 1000).alias("ord"), F.concat(F.lit(f"{label} "), number, F.lit(tail)).alias("label"), F.col(f"x.{field}").alias("fact"), F.col("x.evidence").alias("evidence")))
        n += 1
    for i, (column, label, with_fact) in enumerate(SCALARS):
        evidence = F.col(f"{column}_evidence")
        parts.append(profiles.filter(F.coalesce(evidence, F.lit("")) != "").select("profile_id", F.lit((50 + i) * 1000).alias("ord"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("fact"), evidence.alias("evidence")))
        if with_fact:
            there = F.coalesce(F.col(column), F.lit("")) != ""
            parts.append(profiles.filter(there & (F.col(column) != "unknown") if column == "work_mode" else there).select("profile_id", F.lit((200 + i) * 1000).alias("ord"), F.lit(label).alias("label"), F.col(column).alias("fact"), F.coalesce(evidence, F.lit("")).alias("evidence")))
    rows = profiles.select("profile_id", F.posexplode("employment_types").alias("pos", "fact"), F.coalesce("employment_types_evidence", F.lit("")).alias("evidence"))
    parts.append(rows.select("profile_id", (F.col("pos") + 300_000).alias("ord"), F.lit("employment-type preferences").alias("label"), "fact", "evidence"))
    return reduce(DataFrame.unionByName, parts)


def evidence_issues(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims whose evidence isn't in sources(profile_id, text), and facts that aren't in their evidence; each once."""
    texts = sources.select("profile_id", evidence_key("text").alias("source_key"))
    shown = claims.filter("fact is null").withColumn("key", evidence_key("evidence")).hint("merge").join(texts.hint("merge"), "profile_id", "left")
    missing = shown.filter((F.col("key") == "") | ~F.contains(F.coalesce("source_key", F.lit("")), F.col("key"))).select("profile_id", "ord", "label", F.lit("evidence_not_in_source").alias("reason"))
    facts = claims.filter("fact is not null and fact <> ''").withColumns({"key": fact_key("fact"), "evidence_key": fact_key("evidence")})
    unproven = facts.filter(~F.contains("evidence_key", "key")).select("profile_id", "ord", "label", F.lit("fact_not_in_evidence").alias("reason"))
    return missing.unionByName(unproven).groupBy("profile_id", "label", "reason").agg(F.min("ord").alias("ord"))


def text_issues(text: Column, sources: Column, ascii_only: bool = False) -> Column:
    """Issue codes of a text against an array of source texts.

    Sources are looked at only where the text holds a measured claim or a quotation.
    """
    known = F.flatten(F.transform(sources, lambda s: X.measured_claims(s)))
    joined = F.concat_ws("\n", sources)
    unproven = F.coalesce(text, F.lit("")).rlike(X.MEASURED) & (F.size(F.array_except(X.measured_claims(text), known)) > 0)
    claims, source = X.quoted_claims(text, ascii_only), F.coalesce(explanation(joined, ascii_only), F.lit(""))
    # the source goes in as an array, since a lambda can't hold the normalising UDF
    quoted = F.exists(F.zip_with(claims, F.array_repeat(source, F.size(claims)), lambda q, s: ~F.contains(s, q)), lambda x: x)
    if ascii_only:  # normalising may make a quotation mark of another character otherwise
        quoted = F.contains(F.coalesce(text, F.lit("")), F.lit('"')) & quoted
    return F.array_compact(F.array(F.when(X.protected(text), "protected_attribute_language"), F.when(unproven, "unsupported_measured_claim"), F.when(quoted, "unsupported_quoted_claim")))


# scalar and list fields of requirements that are references, in order; work mode and employment type count unless unknown
_SCALAR_FIELDS = ("minimum_experience", "location", "work_mode", "employment_type")
_LIST_FIELDS = ("language", "education", "certification")
MOST_REFERENCES = 100


def requirement_references(requirements: DataFrame, skills: DataFrame, rules: DataFrame) -> DataFrame:
    """G1: requirements_id, ordinal, reference, label, category: skills, scalar fields, list fields, then rules; the summary alone if there is nothing else.

    requirements may carry minimum_experience (decimal years), location,
    work_mode, employment_type, language, education and certification (arrays)
    and summary; what it lacks counts as empty.
    """
    where = lambda n: F.struct(F.lit(n).alias("g"), F.lit("").alias("a"), F.lit(0).alias("b"))
    row = lambda o, ref, label, kind: ["requirements_id", o.alias("o"), ref.alias("reference"), label.alias("label"), kind.alias("category")]
    at = lambda g, x, y: F.struct(F.lit(g).alias("g"), x.alias("a"), y.cast("int").alias("b"))
    parts = [skills.select(*row(at(0, F.col("importance"), F.col("pos")), F.concat(F.lit("skill:"), F.col("skill")), F.col("skill"), F.col("importance")))]
    for i, name in enumerate(c for c in _SCALAR_FIELDS if c in requirements.columns):
        value = F.concat(F.lit("At least "), F.col(name).cast("string"), F.lit(" years of experience")) if name == "minimum_experience" else F.col(name)
        there = F.coalesce(F.col(name).cast("string"), F.lit("")).isin("", "unknown") if name in ("work_mode", "employment_type") else F.coalesce(F.col(name).cast("string"), F.lit("")) == ""
        parts.append(requirements.filter(~there).select(*row(where(1 + i), F.lit(f"field:{name}"), value, F.lit(name))))
    for i, name in enumerate(c for c in _LIST_FIELDS if c in requirements.columns):
        rows = requirements.select("requirements_id", F.posexplode(name).alias("n", "value"))
        parts.append(rows.select(*row(at(10 + i, F.lit(""), F.col("n")), F.concat(F.lit(f"field:{name}:"), (F.col("n") + 1).cast("string")), F.col("value"), F.lit(name))))
    kind = F.col("rule_type")
    labels = F.create_map(*[F.lit(x) for pair in RULE_LABELS.items() for x in pair])
    shown = F.concat_ws(": ", labels[kind], expected_value(kind, F.col("expected"), F.col("tenths")))
    parts.append(rules.select(*row(at(20, kind, F.lit(0)), F.concat(F.lit("rule:"), kind), shown, F.concat(F.lit("hard_constraint:"), kind))))
    rows = reduce(DataFrame.unionByName, parts)
    if "summary" in requirements.columns:
        bare = requirements.withColumn("said", strip(F.coalesce("summary", F.lit("")))).filter("said <> ''").hint("merge").join(rows.select("requirements_id").distinct().hint("merge"), "requirements_id", "left_anti")
        rows = rows.unionByName(bare.select(*row(where(30), F.lit("field:summary"), F.col("said"), F.lit("summary"))))
    order = Window.partitionBy("requirements_id").orderBy("o", "reference", "label")
    return rows.withColumn("ordinal", F.row_number().over(order)).select("requirements_id", "ordinal", "reference", "label", "category")


def reference_bounds(requirements: DataFrame, references: DataFrame, most: int = MOST_REFERENCES) -> DataFrame:
    """G1: requirements that can't be assessed, with no_requirements or too_many_requirements."""
    n = references.groupBy("requirements_id").agg(F.count("*").alias("n"))
    rows = requirements.select("requirements_id").hint("merge").join(n.hint("merge"), "requirements_id", "left")
    return rows.withColumn("issue", F.when(F.col("n").isNull(), "no_requirements").when(F.col("n") > most, "too_many_requirements")).filter("issue is not null").select("requirements_id", "issue")


# groups of a profile with the name of their references and the field that labels them
_EVIDENCE_GROUPS = (("skill", "skills", "name"), ("employment", "employment", "job_title"), ("language", "languages", "language"), ("education", "education", "qualification"), ("certification", "certifications", "name"))


def evidence_references(profiles: DataFrame) -> DataFrame:
    """profile_id, ordinal, reference, label, evidence: what of a confirmed profile can be cited; facts without evidence can't.

    The summary comes first, then the groups by position, then location, work
    mode, availability and employment types.
    """
    row = lambda g, n, ref, label, proof: ["profile_id", F.struct(F.lit(g).alias("g"), n.alias("n")).alias("o"), ref.alias("reference"), label.alias("label"), proof.alias("evidence")]
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    scalar = lambda g, name, column, rows: rows.filter(~blank(column) & ~blank(f"{column}_evidence")).select(*row(g, F.lit(0), F.lit(f"profile:{name}"), F.col(column), F.col(f"{column}_evidence")))
    parts = [scalar(0, "summary", "summary", profiles)]
    for g, (name, column, field) in enumerate(_EVIDENCE_GROUPS, 1):
        rows = profiles.select("profile_id", F.posexplode(column).alias("n", "x"))
        label = F.col(f"x.{field}")
        if name == "skill":
            years = F.col("x.years_experience").cast("string")
            label = F.when(years.isNotNull(), F.concat(label, F.lit(" ("), years, F.lit(" years)"))).otherwise(label)
        parts.append(rows.select(*row(g, F.col("n"), F.concat(F.lit(f"profile:{name}:"), (F.col("n") + 1).cast("string")), label, F.col("x.evidence"))))
    parts += [scalar(10, "location", "location", profiles), scalar(11, "work_mode", "work_mode", profiles.filter("work_mode <> 'unknown'")), scalar(12, "availability", "availability", profiles)]
    rows = profiles.filter(~blank("employment_types_evidence")).select("profile_id", F.posexplode("employment_types").alias("n", "x"), "employment_types_evidence")
    parts.append(rows.select(*row(13, F.col("n"), F.concat(F.lit("profile:employment_type:"), (F.col("n") + 1).cast("string")), F.col("x"), F.col("employment_types_evidence"))))
    order = Window.partitionBy("profile_id").orderBy("o")
    return reduce(DataFrame.unionByName, parts).withColumn("ordinal", F.row_number().over(order)).drop("o").select("profile_id", "ordinal", "reference", "label", "evidence")


def reference_issues(findings: DataFrame, required: DataFrame, known: DataFrame) -> DataFrame:
    """G3, U3, U4 over findings(assessment_id, requirement_id, category, evidence_ids): references against required(assessment_id, requirement_id) and known(assessment_id, evidence_id)."""
    asked, got = required.select("assessment_id", "requirement_id").distinct(), findings.select("assessment_id", "requirement_id")
    code = lambda df, c, x: df.select("assessment_id", F.lit(c).alias("issue"), F.col(x).alias("reference"))
    cited = findings.select("assessment_id", F.explode("evidence_ids").alias("evidence_id"))
    twice = got.groupBy("assessment_id", "requirement_id").count().filter("count > 1")
    bare = findings.filter("category in ('match', 'gap') and coalesce(size(evidence_ids), 0) < 1")
    parts = [
        code(asked.hint("merge").join(got.hint("merge"), ["assessment_id", "requirement_id"], "left_anti"), "requirement_not_assessed", "requirement_id"),
        code(got.hint("merge").join(asked.hint("merge"), ["assessment_id", "requirement_id"], "left_anti").distinct(), "unknown_requirement", "requirement_id"),
        code(cited.hint("merge").join(known.hint("merge"), ["assessment_id", "evidence_id"], "left_anti").distinct(), "unknown_evidence", "evidence_id"),
        code(twice, "requirement_repeated", "requirement_id"), code(bare, "evidence_required", "requirement_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def findings_by_outcome(findings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Findings with their requirement's label, grouped into match, gap and uncertain arrays in order of the requirement."""
    rows = findings.join(requirements.select("assessment_id", "requirement_id", "ordinal", "label"), ["assessment_id", "requirement_id"], "left")
    item = F.struct("ordinal", "requirement_id", "label", "explanation")
    of = lambda c: F.array_sort(F.collect_list(F.when(F.col("category") == c, item))).alias(c)
    return rows.groupBy("assessment_id").agg(of("match"), of("gap"), of("uncertain"))


def finding_issues(findings: DataFrame) -> DataFrame:
    """Issue codes of each finding.

    findings(assessment_id, category, explanation, requirement (struct label,
    evidence, as stored), reference (the same as known now, null if unknown),
    stored and known (arrays of struct id, label, evidence)).  Stored evidence
    counts as far as it is known.  Findings in plain ASCII never leave the JVM.
    """
    said = lambda a: F.flatten(F.transform(a, lambda e: F.array(e["label"], e["evidence"])))
    plain = is_ascii(F.concat_ws("", "explanation", "reference.label", "reference.evidence", said("stored")))
    return _issues_of(findings.filter(plain), True).unionByName(_issues_of(findings.filter(~plain), False))


def _issues_of(findings: DataFrame, ascii_only: bool) -> DataFrame:
    known_ids = F.transform("known", lambda k: k["id"])
    # columns of their own, so that each is worked out once a row
    columns, resolved, tokens = findings.columns, F.col("_resolved"), F.col("_tokens")
    findings = findings.withColumn("_resolved", F.filter("stored", lambda e: F.array_contains(known_ids, e["id"])))
    exact = F.forall("stored", lambda e: F.exists("known", lambda k: k.eqNullSafe(e)))
    once = F.size(F.array_distinct(F.transform("stored", lambda e: e["id"]))) == F.size("stored")
    words = lambda a: F.concat_ws(" ", F.flatten(F.transform(a, lambda e: F.array(e["label"], e["evidence"]))))
    wanted = F.concat_ws(" ", "reference.label", "reference.evidence")
    lexical = F.arrays_overlap(X.meaningful_tokens(words(resolved), ascii_only), tokens)
    silent = strip(F.coalesce("explanation", F.lit(""))) == ""
    sources = F.array_compact(F.concat(F.array("reference.label", "reference.evidence"), F.flatten(F.transform(resolved, lambda e: F.array(e["label"], e["evidence"])))))
    could = (F.col("category") == "match") & F.col("reference").isNotNull() & (F.size(resolved) > 0) & ~silent
    findings = findings.withColumn("_tokens", F.when(could, X.meaningful_tokens(wanted, ascii_only)))
    match = could & (F.size(tokens) > 0)
    codes = F.array_compact(F.array(
        F.when(~F.col("requirement").eqNullSafe(F.col("reference")), "invalid_requirement_snapshot"), F.when(~F.coalesce(exact & once, F.lit(False)), "invalid_evidence_snapshot"),
        F.when(F.col("category").isin("match", "gap") & (F.coalesce(F.size(resolved), F.lit(0)) < 1), "missing_required_evidence"), F.when(silent, "invalid_explanation_text"),
        F.when(match & ~F.coalesce(lexical, F.lit(False)), "match_without_lexical_support"),
    ))
    issues = F.concat(codes, F.when(silent, F.array().cast("array<string>")).otherwise(text_issues(F.col("explanation"), sources, ascii_only)))
    return findings.select(*[F.col(f"`{c}`") for c in columns], issues.alias("issues"))


def assessment_review(findings: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Each assessment clean or flagged with its distinct issues; those expected but not reviewed are unavailable."""
    rows = findings.groupBy("assessment_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"))
    rows = rows.withColumn("review", F.when(F.size("issues") > 0, "flagged").otherwise("clean"))
    return rows if expected is None else expected.select("assessment_id").distinct().join(rows, "assessment_id", "left").fillna({"review": "unavailable"})


def review_report(reviews: DataFrame) -> DataFrame:
    """Expected, reviewed, clean and flagged assessments; complete if all were reviewed, passing if none is flagged either."""
    of = lambda s: F.count_if(F.col("review") == s)
    rows = reviews.agg(F.count("*").alias("expected"), (of("clean") + of("flagged")).alias("reviewed"), of("clean").alias("clean"), of("flagged").alias("flagged"))
    complete = F.col("reviewed") == F.col("expected")
    return rows.withColumn("complete", complete).withColumn("passing", complete & (F.col("flagged") == 0))


def issue_counts(reviews: DataFrame) -> DataFrame:
    """A13."""
    return reviews.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def context_size(contexts: DataFrame, limit: int = 80_000) -> DataFrame:
    """Characters of the serialised context and whether they keep within the limit."""
    return contexts.withColumn("context_chars", F.length(F.to_json(F.struct(*[c for c in contexts.columns])))).withColumn("fits", F.col("context_chars") <= limit)


def python_length(text: Column) -> Column:
    """Length of text as JSON with every character beyond ASCII escaped."""
    wide = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F\x{10000}-\x{10FFFF}]", ""))
    return F.length(text) + 11 * wide + 5 * other


def outreach_context(decisions: DataFrame, facts: int = 8, evidence: int = 3, limit: int = 20_000) -> DataFrame:
    """decisions(decision_id, organization_name, vacancy_title, findings) with the minimised context and whether it fits.

    findings is an array of struct(requirement_label, candidate_evidence), the
    latter an array of struct(evidence).  The first ``facts`` findings count, the
    first ``evidence`` values of each; findings left without a label or evidence
    go.  The size is that of JSON with blanks after separators, ASCII only.
    """
    shown = lambda f: F.filter(F.transform(F.slice(f["candidate_evidence"], 1, evidence), lambda e: bounded(e["evidence"], 500)), lambda x: x != "")
    listed = F.transform(F.slice("findings", 1, facts), lambda f: F.struct(shown(f).alias("candidate_evidence"), bounded(f["requirement_label"], 300).alias("vacancy_requirement")))
    rows = decisions.withColumn("facts", F.filter(listed, lambda f: (f["vacancy_requirement"] != "") & (F.size(f["candidate_evidence"]) > 0)))
    context = F.struct(
        F.col("facts").alias("approved_match_facts"), F.lit(X.PLACEHOLDER).alias("candidate_name_placeholder"), bounded(F.col("organization_name"), 200).alias("organization_name"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), bounded(F.col("vacancy_title"), 200).alias("vacancy_title"),
    )
    inner = F.aggregate(F.transform("facts", lambda f: F.size(f["candidate_evidence"]) + 2), F.lit(0), lambda a, x: a + x)
    blanks = 9 + F.greatest(F.size("facts") - 1, F.lit(0)) + inner
    rows = rows.withColumn("context", F.to_json(context)).withColumn("context_chars", python_length(F.col("context")) + blanks)
    return rows.select("decision_id", "facts", "context", "context_chars", (F.col("context_chars") <= limit).alias("fits"))


def extraction_issues(profiles: DataFrame) -> DataFrame:
    """Extracted profiles that say nothing and don't tell why, give facts without evidence, or repeat list items in other case.

    Fact columns that the table lacks count as empty.
    """
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != "" if c in profiles.columns else F.lit(False)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0 if c in profiles.columns else F.lit(False)
    mode = (F.col("work_mode") != "unknown") & there("work_mode") if "work_mode" in profiles.columns else F.lit(False)
    scalars = ((there("summary"), "summary"), (there("location"), "location"), (mode, "work_mode"), (some("employment_types"), "employment_types"), (there("availability"), "availability"))
    groups = [g for g, _, _ in GROUPS if g in profiles.columns]
    facts = reduce(lambda a, b: a | b, [c for c, _ in scalars] + [some(g) for g in groups])
    bare = reduce(lambda a, b: a | b, [c & ~there(f"{n}_evidence") for c, n in scalars] + [F.exists(g, lambda x: F.coalesce(x["evidence"], F.lit("")) == "") for g in groups])
    twice = lambda keys: F.size(F.array_distinct(keys)) < F.size(keys)
    repeats = [(twice(F.transform("skills", lambda x: F.lower(x["name"]))), "skills_repeat")] if "skills" in groups else []
    repeats += [(twice(F.transform(c, F.lower)), f"{c}_repeat") for c in ("employment_types", "ambiguities") if c in profiles.columns]
    checks = [(~facts & ~some("ambiguities"), "no_facts"), (bare, "evidence_required"), *repeats]
    return profiles.withColumn("issues", F.array_compact(F.array(*[F.when(c, n) for c, n in checks])))


def disjoint_issues(requirements: DataFrame) -> DataFrame:
    """Requirements whose must and nice lists share a name in any case."""
    names = lambda c: requirements.select("requirements_id", F.explode(c).alias("name")).select("requirements_id", fold(F.col("name")).alias("name"))
    both = names("must").hint("merge").join(names("nice").hint("merge"), ["requirements_id", "name"]).select("requirements_id").distinct()
    return requirements.hint("merge").join(both.hint("merge"), "requirements_id", "left_semi")
