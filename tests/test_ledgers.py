"""Goldens of usage, versions, retention and evaluation; sources of the frozen set."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from matchloom.operators import quality_rules as Q
from matchloom.operators import ranking_eval as L
from matchloom.operators import retention as K
from matchloom.operators import review as R
from matchloom.operators import scoring as S
from matchloom.operators import usage as A
from matchloom.operators import versions as V
from matchloom.sources import files

USAGE = "event_id int, org_id int, workflow string, status string, provider_request_id string, model string, duration_ms decimal(16,3), retries_used int, input_tokens int, output_tokens int, total_tokens int, estimated_cost_usd decimal(18,9)"


def ledger(spark):
    d = Decimal
    rows = [
        (1, 1, "candidate_profile", "succeeded", "r1", "m", d(100), 1, 10, 5, 15, d("0.001")), (2, 1, "candidate_profile", "succeeded", "r2", "m", d(200), 2, 20, 10, 30, d("0.002")),
        (3, 1, "match_assessment", "failed", "r3", "", d(300), 0, None, None, None, None), (4, 1, "match_assessment", "failed", "", "", None, 5, None, None, None, None), (5, 1, "outreach_draft", "pending", "", "", None, 0, None, None, None, None),
    ]
    return spark.createDataFrame(rows, USAGE)


def test_usage_golden(spark):
    r = A.overall(ledger(spark)).first()
    assert (r.attempts, r.succeeded, r.failed, r.pending, r.success_rate) == (5, 2, 2, 1, Decimal("50.0"))
    assert (r.input_tokens, r.output_tokens, r.total_tokens, r.total_tokens_known, r.total_tokens_missing) == (30, 15, 45, 2, 3)
    assert (r.cost_usd, r.cost_usd_known, r.average_duration_ms, r.duration_known) == (Decimal("0.003000000"), 2, Decimal("200.000"), 3)
    assert (r.retries_used, r.retried_attempts, r.retries_known) == (3, 2, 3)


def test_rate_is_null_without_completed(spark):
    r = A.overall(ledger(spark).filter("status = 'pending'")).first()
    assert r.success_rate is None and r.attempts == 1


def test_period_defaults(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "x"), (2, "2024-02-25 00:00:00", "x")], "i int, t string, workflow string").withColumn("started_at", F.to_timestamp("t"))
    assert [r.i for r in A.within(df, "2024-03-01", "nonsense", "nonsense").collect()] == [2] and A.within(df, "2024-03-01", "all").count() == 2


def test_versions(spark):
    v = spark.createDataFrame([(1, 1, "confirmed", "a"), (1, 2, "confirmed", "b"), (2, 1, "confirmed", "c"), (2, 2, "draft", "d")], "k int, version int, status string, x string")
    assert [(r.k, r.version, r.status, r.x) for r in V.carry_forward(v, "k", ["x"]).collect()] == [(1, 3, "draft", "b")]
    keys = V.batch_key(spark.createDataFrame([(1, 2, "h2"), (1, 1, "h1")], "org int, id int, hash string"), ["org"], "v1")
    assert keys.first().batch_key == V.batch_key(spark.createDataFrame([(1, 1, "h1"), (1, 2, "h2")], "org int, id int, hash string"), ["org"], "v1").first().batch_key


def test_outreach_gates(spark):
    cols = "decision_gate string, is_latest_decision boolean, decision string, is_latest_draft boolean, approved boolean, contact_gate string"
    rows = [("ok", True, "approved", True, False, "ok"), ("ok", True, "approved", True, True, "ok"), ("inputs_changed", True, "approved", True, True, "ok"), ("ok", False, "approved", True, False, "ok"), ("ok", True, "approved", True, False, "not_permitted")]
    got = [(r.draft_gate, r.approve_gate, r.action_gate) for r in V.outreach_eligibility(spark.createDataFrame(rows, cols)).collect()]
    assert got == [("ok", "ok", "not_approved"), ("ok", "already_approved", "ok"), ("decision_outdated", "draft_outdated", "draft_outdated"), ("not_latest_decision", "draft_outdated", "not_approved"), ("ok", "contact_blocked", "not_approved")]


def test_retention_is_idempotent(spark):
    c = spark.createDataFrame([(1, 1, "A", "active", "2024-01-01"), (2, 1, "B", "inactive", "2024-12-01"), (3, 2, "C", "active", None), (4, 1, "D", "deleted", "2024-01-01")], "candidate_id int, org_id int, full_name string, status string, d string").withColumn("retention_until", F.to_date("d")).drop("d")
    counts, snap, events = K.retention_run(c, "2024-06-01")
    assert {r.org_id: r.flagged for r in counts.collect()} == {1: 1, 2: 0} and [(r.candidate_id, r.status_before) for r in events.collect()] == [(1, "active")]
    assert K.retention_run(snap.drop("status_before_deletion_request"), "2024-06-01")[2].count() == 0
    ids = spark.createDataFrame([(1,), (2,)], "candidate_id int")
    back = {r.candidate_id: r.status for r in K.cancel_deletions(snap, ids).collect()}
    assert back[1] == "active" and back[2] == "inactive"
    tomb, kids = K.purge(snap, ids, {"source": ids})
    gone = {r.candidate_id: (r.status, r.full_name, r.retention_until) for r in tomb.collect()}
    assert gone[1] == ("deleted", "Deleted candidate #1", None) and gone[2][0] == "inactive" and [r.candidate_id for r in kids["source"].collect()] == [2]
    assert [r.candidate_id for r in K.identity_issues(tomb).collect()] == [4]


def test_frozen_set(spark, tmp_path):
    skills = {"C01": ["a", "b", "c"], "C02": ["a", "b"], "C03": ["a"], "C04": ["c"], "C05": []}
    data = {
        "dataset_id": "d", "candidates": [{"code": c, "full_name": c, "location": "", "summary": "", "skills": s} for c, s in skills.items()],
        "vacancies": [{"code": "V01", "title": "t", "description": "", "summary": "", "must_have_skills": ["a", "b"], "nice_to_have_skills": ["c"], "expected_top": [{"candidate_code": "C01", "score": "100.00"}], "relevance_judgments": {"C01": 3, "C02": 2, "C03": 1, "C04": 1, "C05": 7}}],
    }
    (tmp_path / "d.json").write_text(json.dumps(data))
    ds = files.frozen_dataset(spark, str(tmp_path / "d.json"))
    assert [(r.vacancy, r.issue) for r in files.dataset_issues(ds).collect()] == [("V01", "grade_out_of_range")]
    cand = ds.select(F.posexplode("candidates").alias("candidate_id", "c"))
    c = cand.select(F.col("candidate_id").cast("long"), F.lit(1).alias("org_id"), F.lit("").alias("location"), F.lit("active").alias("status"))
    s = cand.select(F.col("candidate_id").cast("long"), F.explode("c.skills").alias("skill"), F.lit(None).cast("int").alias("years_tenths"))
    v = ds.select(F.explode("vacancies").alias("v"))
    w = v.select(F.lit(1).cast("long").alias("requirements_id"), F.posexplode("v.must_have_skills").alias("pos", "skill")).withColumn("importance", F.lit("must_have")).unionByName(
        v.select(F.lit(1).cast("long").alias("requirements_id"), F.posexplode("v.nice_to_have_skills").alias("pos", "skill")).withColumn("importance", F.lit("nice_to_have")))
    req = spark.createDataFrame([(1, 1)], "requirements_id long, org_id int")
    rules = spark.createDataFrame([], "requirements_id long, rule_type string, expected string, tenths int")
    got = [(r.candidate_id, r.score_cents) for r in S.shortlist(req, w, rules, c, s).orderBy("rank").collect()]
    assert got == [(0, 10_000), (1, 8_000), (2, 4_000), (3, 2_000), (4, 0)]
    ranked = spark.createDataFrame([("V01", f"C0{i}", i) for i in range(1, 6)], "query_id string, doc_id string, rnk int")
    judged = spark.createDataFrame([("V01", c, g) for c, g in (("C01", 3), ("C02", 2), ("C03", 1), ("C04", 1), ("C05", 0))], "query_id string, doc_id string, grade int")
    assert L.at_k(ranked, judged).first()[1:] == (Decimal("1.0000"), Decimal("0.4000"))
    assert L.at_k(ranked.limit(4), judged).first()[1:] == (None, None)
    assert L.at_k(ranked, judged.withColumn("grade", F.lit(0))).first()[1] == Decimal("0.0000")
    assert L.overlap_at_k(ranked, ranked.filter("rnk <= 5").withColumn("doc_id", F.when(F.col("rnk") > 3, "zz").otherwise(F.col("doc_id")))).first()[1] == Decimal("0.6000")


def test_rules_treat_unknown_as_fine(spark):
    t = {"t": spark.createDataFrame([(1, 5), (2, None), (3, -1), (3, -2)], "id int, x int")}
    got = {(r.rule, r.key, r["count"]) for r in Q.run(t, [Q.Check("x_positive", "t", "id", "x > 0"), Q.Unique("id_once", "t", ("id",))]).collect()}
    assert got == {("x_positive", "3", 2), ("id_once", "3", 2)}


def test_has_requirements(spark):
    df = spark.createDataFrame([(" ", [], None), ("x", None, None), ("", ["a"], None), (None, None, 2)], "t string, a array<string>, n int")
    assert [r[0] for r in df.select(R.has_requirements({"t": "text", "a": "array", "n": "number"})).collect()] == [False, True, True, True]


def test_uniqueness_and_references_as_in_sql(spark):
    t = {
        "t": spark.createDataFrame([(1, None, "a|b", "c"), (2, None, "a", "b|c"), (3, 5, "x", "y"), (4, 5, "x", "y"), (5, 6, None, "y"), (6, 6, None, "y")], "id int, n int, a string, b string"),
        "o": spark.createDataFrame([(5, "x"), (6, "z")], "n int, a string"),
    }
    rules = [Q.Unique("n_once", "t", ("n",)), Q.Unique("pair_once", "t", ("a", "b")), Q.Reference("known", "t", ("n", "a"), "o", ("n", "a")), Q.Reference("single", "t", "n", "o", "n"), Q.Unique("keys", "t", ("a", "b"), "id < 3")]
    got = sorted((r.rule, r.key, r["count"]) for r in Q.run(t, rules).collect())
    assert got == [("n_once", "5", 2), ("n_once", "6", 2), ("pair_once", "x|y", 2)]
    both = Q.run({"t": t["t"].filter("id < 3").unionByName(t["t"].filter("id < 3"))}, [rules[1]]).collect()
    assert sorted(r.key for r in both) == ["a\\|b|c", "a|b\\|c"]


def test_maps_have_one_identity_in_any_order(spark):
    from matchloom.operators import ranking_eval as L

    make = lambda m: spark.createDataFrame([("d", {"k": m, "e": None}, [m])], "dataset_id string, deep map<string,map<string,int>>, listed array<map<string,int>>")
    one, two = (L.dataset_identity(make(m)).first().identity for m in ({"b": 1, "a": 2}, {"a": 2, "b": 1}))
    assert one == two != L.dataset_identity(make({"a": 1, "b": 2})).first().identity
    import hashlib
    import json

    want = json.dumps({"dataset_id": "d", "deep": {"k": {"b": 1, "a": 2}, "e": None}, "listed": [{"b": 1, "a": 2}]}, sort_keys=True, separators=(",", ":"))
    assert one == hashlib.sha256(want.encode()).hexdigest()


def test_batches_go_on_with_their_state(spark, tmp_path):
    """A feed of several files is one batch, and a second run takes only what came after the first; one file a batch had to be written by one task before."""
    from matchloom.plans import streaming_queries as Q

    feed, seen = str(tmp_path / "feed"), []
    for epoch in range(2):
        spark.range(epoch * 10, epoch * 10 + 10, 1, 3).write.mode("append").parquet(feed)
        Q._batches(spark.readStream.schema("id long").parquet(feed), spark, "feed", lambda df, n: seen.append((n, sorted(r.id for r in df.collect()))), str(tmp_path / "state"))
    assert seen == [(0, list(range(10))), (1, list(range(10, 20)))]
