"""Normalisation, redaction, claims and identity proposals against plain Python."""

import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from matchloom.functions import normalize as N
from matchloom.operators import grounding as G
from matchloom.operators import intake as I
from matchloom.operators import text_safety as X


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


NAMES = ["  Straße  ", "ﬁne\tArt", "PLAIN  Text", "", "   ", None, "ＡＢＣ", "İstanbul"]


def test_taxonomy(spark):
    want = [None if v is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", v).strip()).casefold() or None for v in NAMES]
    assert column(spark, NAMES, N.taxonomy) == want


def test_phone_email_display(spark):
    phones = ["+1 (555) 010-9999", "12-34", None, "٣٤٥ 1234567"]
    assert column(spark, phones, N.phone_key) == [x if len(x) >= 7 else "" for x in (re.sub(r"\D", "", v or "") for v in phones)]
    mails = [" A@B.C ", None, "ａb@x.org", "\tA@b.c\n", "STRASSE@x.org", "straße@x.org", "\u00a0x@y.z\u2003"]
    assert column(spark, mails, N.email_key) == [(v or "").strip().casefold() for v in mails]
    assert column(spark, mails, lambda c: N.strip(c)) == [v and v.strip() for v in mails]
    assert column(spark, ["  a \n b "], N.display) == ["a b"]


def test_canonical_json_sorts_every_level(spark):
    df = spark.createDataFrame([(1, {"z": [{"k": 2, "a": None}], "b": "x"})], "id int, body struct<z:array<struct<k:int,a:string>>,b:string>")
    assert df.select(N.canonical_json(df)).first()[0] == '{"body":{"b":"x","z":[{"a":null,"k":2}]},"id":1}'


def test_extracted_text(spark):
    got = column(spark, ["a  \n\tb \x00\r\n\n", "  \n ", None, "x" * 1_000_001], N.extracted_text)
    assert (got[0].text, got[0].error) == ("a\n\tb", None) and got[1].error == got[2].error == "empty_text" and got[3].error == "text_too_long"


def test_evidence_keys(spark):
    assert column(spark, ["C++ – and  C#, node.js", None], N.evidence_key) == ["c++ and c# node.js", ""]
    assert column(spark, ["full-time_work"], N.fact_key) == ["full time work"]


def test_canonical_hash_equals_json(spark):
    df = spark.createDataFrame([('é "q"\t', None, 3)], "a string, b string, c int")
    want = hashlib.sha256(json.dumps({"a": 'é "q"\t', "b": None, "c": 3}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert df.select(N.canonical_hash("a", "b", "c")).first()[0] == want


def test_half_up(spark):
    assert [str(x) for x in column(spark, ["0.125", "0.135"], lambda c: N.half_up(c.cast("decimal(9,4)"), 2))] == ["0.13", "0.14"]


def redact_py(text, known=()):
    lines = []
    for line in text.splitlines():
        lines.append("[CONTACT REDACTED]" if re.match(X.CONTACT_LINE, line) or re.match(X.SENSITIVE_LINE, line) else line)
    out = "\n".join(lines)
    for k in known:
        if k.strip():
            out = re.sub(re.escape(k.strip()), "[CONTACT REDACTED]", out, flags=re.I)
    out = re.sub(X.EMAIL, "[CONTACT REDACTED]", out)
    out = re.sub(X.URL, "[CONTACT REDACTED]", out)
    phone = lambda m: "[CONTACT REDACTED]" if m.group().lstrip().startswith("+") or len(re.sub(r"\D", "", m.group())) >= 10 else m.group()
    return re.sub(r"(?<!\w)\+?\d[\d\s().-]{7,}\d(?!\w)", phone, out)


TEXTS = [
    "Jane Doe\nEmail: j@x.org\nworked 2019 - 2023 at ACME", "Call +44 20 7946 0000 or 020 7946 000 1 now", "see www.site.org/a and HTTPS://b.c", "Age 33\nage: 4\nagency work", "a\\E.b $1 JANE doe", "",
    "ids 123-456-789 and 12345678901", "DOB\nSex - m\nSexton", "no contact\n\nlast\n",
]


@pytest.mark.parametrize("known", [(), ("Jane Doe", "a\\E.b", "")])
def test_redaction(spark, known):
    got = column(spark, TEXTS, lambda c: X.redact(c, *[F.lit(k) for k in known]))
    assert got == [redact_py(t, known) for t in TEXTS]


def test_sensitive_and_protected(spark):
    assert column(spark, TEXTS, X.sensitive) == [any(re.match(X.SENSITIVE_LINE, line) for line in t.splitlines()) for t in TEXTS]
    assert column(spark, ["her nationality", "package", "date  of birth", None], X.protected) == [True, False, True, False]


def test_claims(spark):
    got = column(spark, ["Seven years, 2,50 yrs and 10 % of 3 months; 12yearsold", "100 percent", None], X.measured_claims)
    assert got == [["7 years", "2.5 years", "10 percent", "3 months"], ["100 percent"], []]
    assert column(spark, ['He said "Led  the TEAM" and “x”', None], X.quoted_claims) == [["led the team"], []]


def test_tokens_and_decisions(spark):
    assert sorted(column(spark, ["Must have C# and Größe 12 years of node.js"], X.meaningful_tokens)[0]) == ["grösse", "node.js"]
    assert column(spark, ["You should hire now", "recommends rejecting", "we recommend outreach"], X.decision_language) == [True, False, True]


def test_drafts(spark):
    df = spark.createDataFrame([("Hi", "Dear [Candidate name], talk?"), ("Hi [Candidate name]", "call +1 555 010 9999"), ("x", "[Candidate name] [Candidate name] you're hired")], "subject string, body string")
    assert [r.issues for r in X.draft_issues(df).collect()] == [[], ["contact_data", "placeholder_not_once", "placeholder_in_subject"], ["offer_wording", "placeholder_not_once"]]


def test_identity_proposal(spark):
    rows = [
        ("Curriculum Vitae\nJane van Doe\njane@x.org | +44 20 7946 0000 | Berlin\n", "x.pdf"), ("nothing here", "anna_smith_cv_2020.pdf"), ("Contact\nMob: 555 010 9999\na@b.co, A@B.co, c@d.co", "a.pdf"),
        ("JOHN SMITH\nLeeds · john@x.org\n2019-2023", "f"), ("", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, file string")
    p = [r.proposal for r in I.propose(df, "text", "file").orderBy("i").collect()]
    assert (p[0].full_name, p[0].email, p[0].location, p[0].review_flags) == ("Jane van Doe", "jane@x.org", "Berlin", [])
    assert re.sub(r"\D", "", p[0].phone) == "442079460000"
    assert p[1].full_name == "Anna Smith" and p[1].review_flags == ["name_from_filename", "email_missing", "phone_missing", "location_missing"]
    assert p[2].email == "a@b.co" and "multiple_emails" in p[2].review_flags and p[2].phone == "555 010 9999"
    assert (p[3].full_name, p[3].location) == ("JOHN SMITH", "Leeds") and "phone_missing" in p[3].review_flags
    assert p[4].review_flags == ["name_missing", "email_missing", "phone_missing", "location_missing"]


def test_finding_issues(spark):
    schema = "assessment_id int, category string, explanation string, requirement struct<label:string,evidence:string>, reference struct<label:string,evidence:string>, stored array<struct<id:string,label:string,evidence:string>>, known array<struct<id:string,label:string,evidence:string>>"
    ref, e = ("Python", "5 years of Python"), ("e1", "Skill", "Python since 2015, 6 years")
    rows = [
        (1, "match", "Has 6 years", ref, ref, [e], [e]), (2, "match", "Has 9 years", ("Java", "x"), ref, [], [e]), (3, "gap", " ", ref, ref, [e, e], [e]),
        (4, "match", "fine", ref, ref, [("e2", "Hobby", "chess")], [("e2", "Hobby", "chess")]), (5, "uncertain", 'said "not there"', ref, ref, [("e9", "a", "b")], [e]),
    ]
    got = {r.assessment_id: r.issues for r in G.finding_issues(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == []
    assert got[2] == ["invalid_requirement_snapshot", "missing_required_evidence", "unsupported_measured_claim"]
    assert got[3] == ["invalid_evidence_snapshot", "invalid_explanation_text"]
    assert got[4] == ["match_without_lexical_support"]
    assert got[5] == ["invalid_evidence_snapshot", "unsupported_quoted_claim"]
    reviews = G.assessment_review(G.finding_issues(spark.createDataFrame(rows, schema)), spark.createDataFrame([(i,) for i in range(1, 7)], "assessment_id int"))
    assert {r.assessment_id: r.review for r in reviews.collect()} == {1: "clean", 2: "flagged", 3: "flagged", 4: "flagged", 5: "flagged", 6: "unavailable"}


def test_plain_findings_stay_in_the_jvm(spark):
    """ASCII findings meet no Python; others get the same issues as before, whatever character makes a quotation mark or a digit."""
    schema = "assessment_id int, category string, explanation string, requirement struct<label:string,evidence:string>, reference struct<label:string,evidence:string>, stored array<struct<id:string,label:string,evidence:string>>, known array<struct<id:string,label:string,evidence:string>>"
    ref, e, x = ("Python", "5 years of Python"), ("e1", "Skill", "Python for 6 years"), ("e1", "F\u00e4higkeit", "sagt \u201egut\u201c")
    rows = [
        (1, "match", 'says "six Go"', ref, ref, [e], [e]), (2, "match", "says \uff02six Go\uff02", ref, ref, [e], [e]), (3, "match", "says \u201cPython for\u201d", ref, ref, [e], [e]),
        (4, "match", "has \uff16 years", ref, ref, [e], [e]), (5, "match", 'said "gut"', ref, ref, [x], [x]), (6, "gap", None, ref, None, None, None), (7, "match", "six years", ref, ref, [e], [e]),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.assessment_id: r.issues for r in G.finding_issues(df).collect()}
    assert got[1] == got[2] == ["unsupported_quoted_claim"] and got[3] == got[7] == [] and got[4] == []
    assert got[5] == ["match_without_lexical_support"] and got[6] == ["invalid_requirement_snapshot", "invalid_evidence_snapshot", "missing_required_evidence", "invalid_explanation_text"]
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "_nfkc_fold" not in plan(G._issues_of(df, True).select("issues")) and "_nfkc_fold" in plan(G._issues_of(df, False).select("issues"))


def test_profile_evidence(spark):
    from matchloom import schemas

    blank = dict.fromkeys(["summary", "summary_evidence", "location", "location_evidence", "work_mode", "work_mode_evidence", "availability", "availability_evidence", "employment_types_evidence"], "")
    row = {**blank, "skills": [("C++", "expert in C++", None), ("Go", "knows Rust", None)], "employment": [("Engineer", "ACME", "2019–2020", "Engineer at ACME 2019-2020")], "languages": [], "education": [], "certifications": [], "employment_types": ["full_time"], "location": "Bern", "location_evidence": "lives in Bern", "employment_types_evidence": "wants full time work"}
    order = [f.split(" ")[0] for f in re.sub(r"<[^ ]*>", "", schemas.PROFILE).split(", ")]
    df = spark.createDataFrame([(1, *[row[c] for c in order])], f"profile_id int, {schemas.PROFILE}")
    sources = spark.createDataFrame([(1, "Expert in C++. Engineer at ACME 2019-2020. Lives in Bern; wants full-time work")], "profile_id int, text string")
    got = {(r.label, r.reason) for r in G.evidence_issues(G.profile_claims(df), sources).collect()}
    assert got == {("skill item 2", "evidence_not_in_source"), ("skill item 2", "fact_not_in_evidence")}


def test_redaction_of_random_texts(spark):
    import random

    rnd = random.Random(11)
    parts = ["\n", "\r\n", " ", "Email: x", "phone :", "tel", "AGE", "age", "- ", ": ", "a@b.co", "www.x.y", "https://q", "+", "12", "345 ", "(67)", "8-9", "\t", "x", "dob", "health\n", "\n\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    got = column(spark, texts, X.redact)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != redact_py(t)] == []
    assert column(spark, texts, X.sensitive) == [any(re.match(X.SENSITIVE_LINE, line) for line in t.splitlines()) for t in texts]


def test_outreach_context_size(spark):
    """The size is that of the JSON that Python writes with sorted names, ASCII only."""


    findings = [(" Needs \"Spark\" é ", [("did it",), (" ",), ("😀 two",), ("fourth",)]), ("", [("x",)]), ("no proof", [(None,)])] + [(f"r{i}", [("y" * 600,)]) for i in range(8)]
    df = spark.createDataFrame([(1, "Ö" * 210, " Title ", findings), (2, "O", "T", [])], "decision_id int, organization_name string, vacancy_title string, findings array<struct<requirement_label:string,candidate_evidence:array<struct<evidence:string>>>>")
    got = {r.decision_id: r for r in G.outreach_context(df).collect()}
    for r in got.values():
        assert r.context_chars == len(json.dumps(json.loads(r.context), ensure_ascii=True, sort_keys=True))
    facts = json.loads(got[1].context)["approved_match_facts"]
    assert [f["vacancy_requirement"] for f in facts] == ['Needs "Spark" é', *[f"r{i}" for i in range(5)]] and facts[0]["candidate_evidence"] == ["did it", "😀 two"]
    assert len(facts[1]["candidate_evidence"][0]) == 500 and got[2].fits and not json.loads(got[2].context)["approved_match_facts"]


def test_redaction_of_known_values(spark):

    df = spark.createDataFrame([("call Jane or +44 20 7946 0958 now", "jane", "", None), ("no one", " ", None, "x")], "t string, a string, b string, c string")
    got = [r[0] for r in df.select(X.redact(F.col("t"), F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["call [CONTACT REDACTED] or [CONTACT REDACTED] now", "no one"]


def values_py(text, values):
    for v in values:
        if v and v.strip():
            text = re.sub(re.escape(v.strip()), X.REDACTED, text, flags=re.I)
    return text


def test_many_known_values_equal_one_pass_each(spark):
    import random
    import time

    rnd = random.Random(4)
    parts = ["Ki", "\u212am", "s", "\u017fo", "\u0130", "i", "[", "]", "act", "CON", "red", " ", ".", "\\E", "\\Q", "$1", "\u00c9", "\u00e9", "\u03a3", "\u03c2", "\u03c3", "x", "]x", "d]"]
    word = lambda n: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, n)))
    rows = [(word(30), [rnd.choice([None, " ", word(3), word(2)]) for _ in range(rnd.randint(0, 6))]) for _ in range(600)]
    df = spark.createDataFrame(rows, "t string, v array<string>")
    plain = lambda t, vs: __import__("functools").reduce(X._replace_value, vs, t)
    one_each = plain(F.col("t"), [N.strip(F.coalesce(F.get("v", F.lit(i)), F.lit(""))) for i in range(6)])
    for r, (t, vs) in zip(df.select(X.redact_values(F.col("t"), F.col("v")).alias("got"), one_each.alias("want")).collect(), rows, strict=True):
        assert r.got == r.want, (t, vs)
        if not set("\u0130\u212a\u017f\u03c2") & set(t + "".join(v or "" for v in vs)):
            assert r.got == values_py(t, vs), (t, vs)
    many = spark.createDataFrame([("some words of a text " * 5000 + "value 77x", [f"value {i}x" for i in range(1000)])], "t string, v array<string>")
    began = time.time()
    assert many.select(X.redact_values(F.col("t"), F.col("v"))).first()[0].count(X.REDACTED) == 1
    assert time.time() - began < 10
    assert spark.createDataFrame([(None, ["a"]), ("a", None)], "t string, v array<string>").select(X.redact_values(F.col("t"), F.col("v"))).collect() == [("",), ("a",)]


def test_redaction_of_all_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    from matchloom.plans import text_queries

    got = {r.doc_id: (r.redactions, r.sensitive) for r in text_queries.redaction_counts(spark, sf).collect()}
    assert got == {d: (redact_py(t).count(X.REDACTED), any(re.match(X.SENSITIVE_LINE, line) for line in t.splitlines())) for d, t in docs.items()}
