"""Queries of the matching area: scores, filters, shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import taxonomy
from ..operators import scoring as S
from .fixtures import oracle, view


def _inputs(spark, sf_dir, skills="fx_candidate_skill"):
    v = lambda name: view(spark, sf_dir, name)
    return v("fx_requirements"), v("fx_requirement_skill"), v("fx_rule"), v("fx_candidate"), v(skills)


def told(spark, sf_dir) -> dict:
    """The confirmed profiles and what they tell, as keyword arguments."""
    return {"profiles": view(spark, sf_dir, "fx_profile"), "facts": view(spark, sf_dir, "fx_profile_fact").withColumn("fact_key", taxonomy(F.col("fact")))}


def shortlist_top20(spark, sf_dir):
    return S.shortlist(*_inputs(spark, sf_dir), **told(spark, sf_dir))


def shortlist_fill(spark, sf_dir):
    return S.shortlist(*_inputs(spark, sf_dir, "fx_candidate_skill_sparse"), **told(spark, sf_dir))


def shortlist_breakdown(spark, sf_dir):
    req, wanted, rules, cands, skills = _inputs(spark, sf_dir, "fx_candidate_skill_full")
    rows = S.breakdown(S.shortlist(req, wanted, rules, cands, skills, 3, **told(spark, sf_dir)), wanted, skills)
    item = F.transform("skill_scores", lambda x: F.concat_ws(":", x["skill"], x["awarded_cents"].cast("string"), x["possible_cents"].cast("string"), x["candidate_label"], x["evidence"]))
    return rows.select("requirements_id", "rank", "candidate_id", F.array_join(item, ",").alias("breakdown"))


def shortlist_explained(spark, sf_dir):
    """Every rule's result, sentence and evidence for the first three of each shortlist."""
    req, wanted, rules, cands, skills = _inputs(spark, sf_dir)
    more = told(spark, sf_dir)
    return S.explain(S.shortlist(req, wanted, rules, cands, skills, 3, **more), rules, cands, skills, **more).drop("rule_label", "source_text")


def skill_points(spark, sf_dir):
    return S.skill_points(view(spark, sf_dir, "fx_requirement_skill")).select("requirements_id", "skill", "importance", "pos", "possible_cents")


def filter_report(spark, sf_dir):
    req, _, rules, cands, skills = _inputs(spark, sf_dir)
    return S.filter_report(req, rules, cands, skills, **told(spark, sf_dir))


def run_summary(spark, sf_dir):
    return S.run_summary(filter_report(spark, sf_dir))


def min_experience(spark, sf_dir):
    return S.min_experience(view(spark, sf_dir, "fx_candidate_skill"))


def traffic_lights(spark, sf_dir):
    light = S.traffic_light(F.col("score")).alias("light")
    return view(spark, sf_dir, "fx_assessment").select("entry_id", "version", "score", light)


def rule_expectations(spark, sf_dir):
    return view(spark, sf_dir, "fx_rule").select("requirements_id", "rule_type", S.expected_value(F.col("rule_type"), F.col("expected"), F.col("tenths")).alias("expected_value"))


_POINTS = """
points AS (
  SELECT requirements_id, skill, importance, pos, base + CASE WHEN row_number() OVER (PARTITION BY requirements_id ORDER BY rest DESC, importance, pos) <= 10000 - sum(base) OVER (PARTITION BY requirements_id) THEN 1 ELSE 0 END AS possible_cents
  FROM (SELECT *, 10000 * units // total AS base, (10000 * units) % total AS rest
        FROM (SELECT *, sum(units) OVER (PARTITION BY requirements_id) AS total
              FROM (SELECT *, CASE WHEN importance = 'must_have' THEN 2 ELSE 1 END AS units FROM {fx_requirement_skill})))
)"""

_KEY = "lower(trim(regexp_replace(%s, '\\s+', ' ', 'g')))"

# every active candidate of an organisation against every requirement of it that can be evaluated
_ALL = """
years AS (SELECT candidate_id, max(years_tenths) AS years FROM {@skills} GROUP BY 1),
cand AS (SELECT c.candidate_id, org_id, lower(trim(CASE WHEN c.location <> '' THEN c.location ELSE coalesce(f.location, '') END)) AS place, years
         FROM {fx_candidate} c LEFT JOIN {fx_profile} f ON f.candidate_id = c.candidate_id LEFT JOIN years y ON y.candidate_id = c.candidate_id WHERE status = 'active'),
told AS (SELECT DISTINCT candidate_id, rule_type, lower(fact) AS fact_key FROM {fx_profile_fact}),
rul AS (SELECT *, """ + _KEY % "expected" + """ AS expected_key FROM {fx_rule}),
pair AS (SELECT requirements_id, candidate_id, place, years FROM {fx_requirements} r JOIN cand c ON c.org_id = r.org_id WHERE status = 'confirmed' AND NOT vacancy_deleted),
checked AS (
  SELECT p.requirements_id, p.candidate_id,
         CASE WHEN x.rule_type IS NULL THEN 0
              WHEN x.rule_type = 'location' THEN CASE WHEN place = '' THEN 1 WHEN place = lower(x.expected) THEN 0 ELSE 2 END
              WHEN x.rule_type = 'minimum_experience' THEN CASE WHEN years >= x.tenths THEN 0 ELSE 1 END
              WHEN x.rule_type = 'required_skill' THEN CASE WHEN s.skill IS NULL THEN 1 ELSE 0 END
              ELSE CASE WHEN t.fact_key IS NULL THEN 1 ELSE 0 END END AS state
  FROM pair p LEFT JOIN rul x ON x.requirements_id = p.requirements_id
  LEFT JOIN {@skills} s ON x.rule_type = 'required_skill' AND s.candidate_id = p.candidate_id AND s.skill = x.expected
  LEFT JOIN told t ON t.rule_type = x.rule_type AND t.candidate_id = p.candidate_id AND t.fact_key = x.expected_key
),
outcomes AS (SELECT requirements_id, candidate_id, CASE max(state) WHEN 2 THEN 'failed' WHEN 1 THEN 'review' ELSE 'passed' END AS outcome FROM checked GROUP BY 1, 2)"""

_RANKED = """
scores AS (
  SELECT q.requirements_id, s.candidate_id, sum(possible_cents) AS cents, count(*) FILTER (importance = 'must_have') AS must, count(*) FILTER (importance <> 'must_have') AS nice
  FROM points q JOIN {@skills} s ON s.skill = q.skill GROUP BY 1, 2
),
ranked AS (
  SELECT o.requirements_id, row_number() OVER (PARTITION BY o.requirements_id ORDER BY coalesce(cents, 0) DESC, CASE outcome WHEN 'passed' THEN 0 ELSE 1 END, o.candidate_id) AS rank,
         o.candidate_id, coalesce(cents, 0)::INT AS score_cents, outcome, coalesce(must, 0)::INT AS matched_must, coalesce(nice, 0)::INT AS matched_nice,
         coalesce(all_must, 0)::INT AS total_must, coalesce(all_nice, 0)::INT AS total_nice
  FROM outcomes o LEFT JOIN scores s ON s.requirements_id = o.requirements_id AND s.candidate_id = o.candidate_id
  LEFT JOIN (SELECT requirements_id, count(*) FILTER (importance = 'must_have') AS all_must, count(*) FILTER (importance <> 'must_have') AS all_nice FROM points GROUP BY 1) a
    ON a.requirements_id = o.requirements_id
  WHERE outcome <> 'failed'
)"""


def _over(text: str, skills: str = "fx_candidate_skill") -> str:
    return oracle(text.replace("@skills", skills))


def _shortlist_sql(skills: str) -> str:
    return _over(f"WITH {_POINTS}, {_ALL}, {_RANKED} SELECT * FROM ranked WHERE rank <= 20", skills)


_REPORT = """
report AS (
  SELECT r.requirements_id, count(outcome) AS evaluated, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'review') AS review,
         count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome IN ('passed', 'review')) AS eligible
  FROM {fx_requirements} r LEFT JOIN outcomes o ON o.requirements_id = r.requirements_id WHERE r.status = 'confirmed' AND NOT vacancy_deleted GROUP BY 1
)"""

_EXPLAINED = """
best AS (SELECT candidate_id, skill AS best_skill, years_tenths AS best FROM {fx_candidate_skill} WHERE years_tenths IS NOT NULL QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY years_tenths DESC, skill) = 1),
r AS (
  SELECT k.requirements_id, k.candidate_id, row_number() OVER (PARTITION BY k.requirements_id, k.candidate_id ORDER BY x.rule_type, x.expected) AS position, x.rule_type, x.expected, x.expected_key, x.tenths,
         trim(c.location) AS own, trim(CASE WHEN c.location <> '' THEN c.location ELSE coalesce(f.location, '') END) AS place, f.candidate_id IS NOT NULL AS profiled, f.location_evidence, s.skill IS NOT NULL AS has, best_skill, best,
         (SELECT min_by(fact, pos) FROM {fx_profile_fact} t WHERE t.candidate_id = k.candidate_id AND t.rule_type = x.rule_type AND lower(t.fact) = x.expected_key) AS fact,
         (SELECT min_by(evidence, pos) FROM {fx_profile_fact} t WHERE t.candidate_id = k.candidate_id AND t.rule_type = x.rule_type AND lower(t.fact) = x.expected_key) AS fact_evidence,
         EXISTS (SELECT 1 FROM {fx_profile_fact} t WHERE t.candidate_id = k.candidate_id AND t.rule_type = x.rule_type) AS any_fact
  FROM ranked k JOIN rul x ON x.requirements_id = k.requirements_id JOIN {fx_candidate} c ON c.candidate_id = k.candidate_id LEFT JOIN {fx_profile} f ON f.candidate_id = k.candidate_id
  LEFT JOIN {fx_candidate_skill} s ON x.rule_type = 'required_skill' AND s.candidate_id = k.candidate_id AND s.skill = x.expected LEFT JOIN best b ON b.candidate_id = k.candidate_id WHERE rank <= 3
),
e AS (
  SELECT *, CASE rule_type WHEN 'required_skill' THEN CASE WHEN has THEN 'skill_matched' ELSE 'skill_missing' END
                           WHEN 'minimum_experience' THEN CASE WHEN best IS NULL THEN 'years_unknown' WHEN best >= tenths THEN 'years_met' ELSE 'years_below' END
                           WHEN 'location' THEN CASE WHEN place = '' THEN 'place_unknown' WHEN lower(place) = expected_key THEN 'place_matched' ELSE 'place_other' END
                           ELSE CASE WHEN NOT profiled THEN 'no_profile' WHEN NOT any_fact THEN 'no_fact' WHEN fact IS NULL THEN 'no_match' ELSE 'matched' END END AS reason,
         CASE WHEN best % 10 = 0 THEN CAST(best // 10 AS STRING) ELSE concat(CAST(best // 10 AS STRING), '.', CAST(best % 10 AS STRING)) END AS years_text,
         replace(rule_type, '_', ' ') AS kind
  FROM r
)
SELECT requirements_id, candidate_id, CAST(position AS INT) AS position, rule_type, CASE WHEN reason = 'place_other' THEN 'failed' WHEN reason IN ('skill_matched', 'years_met', 'place_matched', 'matched') THEN 'passed' ELSE 'unknown' END AS outcome, reason,
  CASE WHEN rule_type = 'minimum_experience' THEN concat('At least ', CAST(tenths // 10 AS STRING), ' years') ELSE expected END AS expected_value,
  coalesce(CASE rule_type WHEN 'required_skill' THEN CASE WHEN has THEN expected END WHEN 'minimum_experience' THEN CASE WHEN best IS NOT NULL THEN concat(years_text, ' years with ', best_skill) END WHEN 'location' THEN nullif(place, '') ELSE fact END, 'Not recorded') AS candidate_value,
  CASE reason WHEN 'skill_matched' THEN concat('The recorded skill matches ', expected, '.')
    WHEN 'skill_missing' THEN concat('No structured ', expected, ' skill fact is recorded. Absence is not evidence that the candidate lacks the skill.')
    WHEN 'years_met' THEN 'Recorded skill experience proves the minimum duration is met.'
    WHEN 'years_below' THEN 'Recorded skill experience is below the threshold, but partial skill evidence cannot prove the candidate''s total experience is insufficient.'
    WHEN 'years_unknown' THEN 'No structured candidate experience duration is recorded.'
    WHEN 'place_matched' THEN 'The recorded candidate location matches the required location.' WHEN 'place_other' THEN 'The recorded candidate location does not match the required location.'
    WHEN 'place_unknown' THEN 'No structured candidate location is recorded.' WHEN 'matched' THEN 'The confirmed candidate profile contains a matching source-grounded fact.'
    WHEN 'no_profile' THEN concat('No confirmed candidate profile supplies a structured ', kind, ' fact. The candidate remains eligible for recruiter review.')
    WHEN 'no_fact' THEN concat('No structured candidate ', kind, ' fact is recorded.')
    ELSE 'The confirmed profile has related facts, but they do not prove this requirement. Absence is not treated as a failure.' END AS explanation,
  coalesce(CASE rule_type WHEN 'required_skill' THEN '' WHEN 'minimum_experience' THEN '' WHEN 'location' THEN CASE WHEN own <> '' THEN 'Candidate record location' WHEN place <> '' THEN location_evidence END ELSE fact_evidence END, '') AS evidence
FROM e"""


def sql() -> dict[str, str]:
    return {
        "shortlist_top20": _shortlist_sql("fx_candidate_skill"),
        "shortlist_fill": _shortlist_sql("fx_candidate_skill_sparse"),
        "shortlist_breakdown": _over(
            f"WITH {_POINTS}, {_ALL}, {_RANKED}"
            + """ SELECT k.requirements_id, rank, k.candidate_id,
              string_agg(concat_ws(':', q.skill, CAST(CASE WHEN s.skill IS NULL THEN 0 ELSE possible_cents END AS STRING), CAST(possible_cents AS STRING), coalesce(s.source_label, 'Not recorded'), coalesce(s.evidence, '')), ',' ORDER BY importance, pos) AS breakdown
              FROM ranked k JOIN points q ON q.requirements_id = k.requirements_id
              LEFT JOIN {fx_candidate_skill_full} s ON s.candidate_id = k.candidate_id AND s.skill = q.skill WHERE rank <= 3 GROUP BY 1, 2, 3"""
        ),
        "shortlist_explained": _over(f"WITH {_POINTS}, {_ALL}, {_RANKED}, {_EXPLAINED}"),
        "skill_points": oracle(f"WITH {_POINTS} SELECT * FROM points"),
        "filter_report": _over(f"WITH {_ALL}, {_REPORT} SELECT * FROM report"),
        "run_summary": _over(f"WITH {_ALL}, {_REPORT} SELECT requirements_id, evaluated, eligible, least(eligible, 20) AS shortlisted FROM report"),
        "min_experience": oracle("""
            SELECT candidate_id, skill, years_tenths, CASE WHEN years_tenths % 10 = 0 THEN CAST(years_tenths // 10 AS STRING)
                   ELSE concat(CAST(years_tenths // 10 AS STRING), '.', CAST(years_tenths % 10 AS STRING)) END AS years_text
            FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY years_tenths DESC, skill) AS n FROM {fx_candidate_skill} WHERE years_tenths IS NOT NULL) WHERE n = 1"""),
        "traffic_lights": oracle("SELECT entry_id, version, score, CASE WHEN score >= 75 THEN 'green' WHEN score >= 50 THEN 'amber' ELSE 'red' END AS light FROM {fx_assessment}"),
        "rule_expectations": oracle("SELECT requirements_id, rule_type, CASE WHEN rule_type = 'minimum_experience' THEN concat('At least ', CAST(tenths // 10 AS STRING), ' years') ELSE expected END AS expected_value FROM {fx_rule}"),
    }


QUERIES = (shortlist_top20, shortlist_fill, shortlist_breakdown, shortlist_explained, skill_points, filter_report, run_summary, min_experience, traffic_lights, rule_expectations)
