"""Import triage, validation, sources and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions.lineage import cut
from matchloom.operators import intake as I
from matchloom.sources import files, sinks


def sequential(rows, pool):
    seen = set()
    keys = lambda r: {(r[1], k, v) for k, v in (("e", r[2].strip().lower()), ("p", "".join(c for c in r[3] if c.isdigit())), ("r", r[4].strip())) if v and not (k == "p" and len(v) < 7)}
    for p in pool:
        seen |= keys(p)
    out = {}
    for r in sorted(rows):
        if not r[5]:
            out[r[0]] = "invalid"
        elif keys(r) & seen:
            out[r[0]] = "duplicate"
        else:
            out[r[0]] = "created"
            seen |= keys(r)
    return out


@pytest.mark.parametrize(("seed", "plain"), [(0, 2), (1, 0), (2, 0)])
def test_triage_equals_the_sequential_rule(spark, seed, plain):
    rnd = random.Random(seed)
    row = lambda i: (i, rnd.randint(0, 1), rnd.choice(["", "a@x.y", "b@x.y", f"m{rnd.randint(0, 30)}@x.y"]), rnd.choice(["", "12", f"55500{rnd.randint(10, 40)}"]), rnd.choice(["", f"r{rnd.randint(0, 30)}"]))
    rows = [(*row(i), rnd.random() > 0.1) for i in range(120)]
    pool = [row(1000 + i) for i in range(5)]
    schema = "row_number long, org_id int, email string, phone string, source_reference string"
    df = spark.createDataFrame(rows, f"{schema}, ok boolean")
    held = spark.createDataFrame(pool, schema).withColumnRenamed("row_number", "candidate_id")
    got = {r.row_number: r.status for r in I.triage(df, held, F.col("ok"), plain_rounds=plain).collect()}
    assert got == sequential(rows, pool)


@pytest.mark.parametrize("broken", [0, 97])
def test_triage_of_a_chain_takes_few_rounds(spark, monkeypatch, broken):
    """Each row shares a key with the next: created, duplicate, created, ...; some chains branch."""
    cuts = []
    monkeypatch.setattr(I, "cut", lambda df: cuts.append(1) or cut(df))
    n = 10_000
    rows = [(i, 0, f"m{i // 2}@x.y", f"55500{10_000 + (i + 1) // 2}", f"r{i // broken}" if broken and i % broken < 3 else "", True) for i in range(n)]
    schema = "row_number long, org_id int, email string, phone string, source_reference string, ok boolean"
    pool = spark.createDataFrame([], "candidate_id long, org_id int, email string, phone string, source_reference string")
    got = {r.row_number: r.status for r in I.triage(spark.createDataFrame(rows, schema), pool).collect()}
    assert got == sequential(rows, [])
    assert len(cuts) < (40 if not broken else 90)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿full_name, email,phone\nAnn,a@x.org,\n ,  ,\n,bad@,\nBob,b@x,5\nCy,c@x.org,1,extra\n", encoding="utf-8")
    rows = files.candidate_csv(spark, str(tmp_path / "a.csv")).orderBy("row_number").collect()
    assert [(r.row_number, r.full_name, r.email, r.location, r.extra_values) for r in rows] == [(2, "Ann", "a@x.org", "", False), (4, "", "bad@", "", False), (5, "Bob", "b@x", "", False), (6, "Cy", "c@x.org", "", True)]
    checked = I.validate(files.candidate_csv(spark, str(tmp_path / "a.csv"))).orderBy("row_number").collect()
    assert [r.reasons for r in checked] == [[], ["full_name_required", "email_invalid"], ["email_invalid"], []]


@pytest.mark.parametrize("header", ["", "email", "full_name,full_name", "full_name,age"])
def test_bad_headers(header):
    with pytest.raises(ValueError):
        files.check_header(header.split(",") if header else [])


def test_identity_conflicts(spark):
    schema = "org_id int, email string, phone string, source_reference string"
    rows = spark.createDataFrame([(1, 0, "A@x.y", "", "r2"), (2, 0, "a@x.y", "5550000", ""), (3, 1, "a@x.y", "", ""), (4, 0, "", "", "")], f"row_number long, {schema}")
    pool = spark.createDataFrame([(7, 0, "a@x.y", "555-0000", "r1"), (9, 0, "", "", "r2")], f"candidate_id long, {schema}")
    got = {r.row_number: (r.candidate_id, r.conflicting, r.reasons) for r in I.identity_matches(rows, pool).collect()}
    assert got == {1: (7, True, "email, source reference"), 2: (7, False, "email, phone")}


def test_skills(spark):
    req = spark.createDataFrame([(1, ["Python", " python ", "SQL"], ["sql", "Go"]), (2, None, [""])], "requirements_id int, must array<string>, nice array<string>")
    got = sorted((r.requirements_id, r.importance, r.pos, r.label) for r in I.sync_requirement_skills(req).collect())
    assert got == [(1, "must_have", 1, "Python"), (1, "must_have", 2, "SQL"), (1, "nice_to_have", 1, "Go")]
    prof = spark.createDataFrame([(1, 5, [("Go",), ("go",), ("SQL",)])], "candidate_id int, document_id int, skills array<struct<name:string>>")
    held = spark.createDataFrame([(1, 5, "java"), (1, 4, "sql")], "candidate_id int, document_id int, normalized_name string")
    gone, new = I.publish_skills(prof, held)
    assert [r.normalized_name for r in gone.collect()] == ["java"] and [r.name for r in new.collect()] == ["Go"]


def test_integrity(spark):
    import hashlib

    content = b"abc"
    reg = spark.createDataFrame([("a", 3, hashlib.sha256(content).hexdigest(), False), ("b", 4, "x", False), ("c", 3, "x", False), ("d", 1, "x", False), ("e", 1, "x", True)], "path string, size_bytes int, sha256 string, is_deleted boolean")
    found = spark.createDataFrame([(p, bytearray(content)) for p in ("a", "b", "c", "e", "z")], "path string, content binary")
    assert {r.path: r.reason for r in I.integrity(reg, found).collect()} == {"a": "ok", "b": "size_mismatch", "c": "hash_mismatch", "d": "file_missing", "e": "deleted_but_present", "z": "unregistered_file"}


def test_documents_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_bytes(b"hello")
    row = files.document_files(spark, str(tmp_path / "in")).first()
    assert (row.path, row.size_bytes) == ("x.txt", 5)
    df = spark.createDataFrame([(1, "S ", " B", True), (2, "s", "b", False)], "draft_id int, subject string, body string, approved boolean")
    sinks.export_drafts(df, str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").rglob("part-*.txt")] == ["Subject: S\n\nB\n"]
    sinks.json_lines(spark.createDataFrame([(2, None)], "b int, a string"), str(tmp_path / "j"))
    assert [t for p in (tmp_path / "j").glob("part-*") if (t := p.read_text())] == ['{"a":null,"b":2}\n']
    sinks.csv_template(spark, str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("part-*")).startswith("full_name,email")
    ev = spark.createDataFrame([(" " + "x" * 300, -1, float("nan"), 1.23456)], "model string, total_tokens int, duration_ms double, estimated_cost_usd double")
    got = sinks.clean_event(ev).first()
    assert len(got.model) == 255 and got.total_tokens is None and got.duration_ms is None and str(got.estimated_cost_usd) == "1.234560000"
    line = spark.range(1).select(sinks.metric_line("cost", F.lit(None).cast("string"), F.lit(1), F.lit(3))).first()[0]
    assert line == "cost: unavailable (1/3)"


def test_delivery(spark):
    import hashlib

    sha = hashlib.sha256(b"abc").hexdigest()
    good = ("g", "x\\y/ cv.pdf ", "cv", I.PDF, "succeeded", 3, sha, False, "active")
    change = lambda path, at, value: (path, *good[1:at], value, *good[at + 1 :])
    rows = [
        (good, "ok"), (change("deleted", 7, True), "document_unavailable"), (change("gone", 8, "deleted"), "document_unavailable"), (change("failed", 4, "failed"), "document_unavailable"),
        (change("other", 2, "letter"), "invalid_document_metadata"), (change("kind", 3, "text/plain"), "invalid_document_metadata"), (change("docx", 3, I.DOCX), "ok"), (change("name", 1, "a/"), "invalid_document_metadata"),
        (change("control", 1, "a\u200b.pdf"), "invalid_document_metadata"), (change("255", 1, "é" * 255), "ok"), (change("256", 1, "é" * 256), "invalid_document_metadata"), (change("size", 5, 4), "document_integrity_failed"),
        (change("hash", 6, ""), "document_integrity_failed"), (change("nohash", 6, None), "document_integrity_failed"), (change("missing", 5, 3), "document_unavailable"), (change("empty", 5, 0), "document_integrity_failed"),
        (change("nullstate", 4, None), "document_unavailable"),
    ]
    registry = spark.createDataFrame([r for r, _ in rows], "path string, original_filename string, document_type string, content_type string, extraction_status string, size_bytes int, sha256 string, is_deleted boolean, candidate_status string")
    stored = spark.createDataFrame([(r[0], bytearray(b"" if r[0] == "empty" else b"abc")) for r, _ in rows if r[0] != "missing"], "path string, content binary")
    got = {r.path: (r.reason, r.filename) for r in I.delivery(registry, stored).collect()}
    assert {p: r for p, (r, _) in got.items()} == {r[0]: want for r, want in rows} and got["g"][1] == "cv.pdf"
    assert {r.reason for r in I.delivery(registry.filter("path = 'g'"), stored, max_bytes=2).collect()} == {"document_integrity_failed"}
    assert I.delivery(registry.limit(0), stored).count() == 0


def test_json_column(spark):
    df = spark.createDataFrame([('["a"]',), ("{}",), ("nope",), (None,)], "j string")
    assert [(r[0].value, r[0].error) for r in df.select(files.decode_json(F.col("j"), "array<string>")).collect()] == [(["a"], None), (None, "not_decodable"), (None, "not_decodable"), (None, None)]


def test_csv_with_a_quoted_header(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"full_name","email", "location"\n"Ann, B",a@b.c,Rome\n'.replace(', "', ',"'))
    rows = files.candidate_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [(r.full_name, r.email, r.location, r.row_number) for r in rows] == [("Ann, B", "a@b.c", "Rome", 2)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("full_name\nAnn\n")
    (tmp_path / "d" / "b.csv").write_text("full_name,email\nBob,b@c.d\n")
    with pytest.raises(ValueError, match="different header"):
        files.candidate_csv(spark, str(tmp_path / "d"))


def test_identity_on_a_shared_number(spark):
    """One number that many rows and many candidates share makes no pairs, and the verdict is that of all of them."""
    rows = spark.createDataFrame([(i, 0, "", "5550000000", "") for i in range(2000)], "row_number long, org_id int, email string, phone string, source_reference string")
    pool = spark.createDataFrame([(i, 0, "", "5550000000", "") for i in range(5, 2000)], "candidate_id long, org_id int, email string, phone string, source_reference string")
    got = I.identity_matches(rows, pool)
    assert got.count() == 2000 and got.select("candidate_id", "conflicting", "reasons").distinct().collect() == [(5, True, "phone")]


def test_emails_once_each(spark):
    df = spark.createDataFrame([("B@x.org a@x.org b@X.org c@x.org a@x.org",), ("none",)], "t string")
    assert [r[0] for r in df.select(I.emails(F.col("t"))).collect()] == [["B@x.org", "a@x.org", "c@x.org"], []]


def test_attached_children_in_blocks(spark):
    from matchloom.operators import review as R

    parents = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    children = spark.createDataFrame([(1, f"c{i:02d}") for i in range(12)] + [(2, "x")], "p int, c string")
    got = sorted((r.p, r.block, r.n_children, [x.c for x in r.children or []]) for r in R.attach(parents, children, "p", "c", 5).collect())
    names = [f"c{i:02d}" for i in range(12)]
    assert got == [(1, 0, 12, names[:5]), (1, 1, 12, names[5:10]), (1, 2, 12, names[10:]), (2, 0, 1, ["x"]), (3, 0, 0, [])]


def test_shortlists_are_stored_whole_or_not_at_all(spark, tmp_path):
    runs = spark.createDataFrame([(1, 0, 5, 4, 2)], "run_id int, org_id int, evaluated int, eligible int, shortlisted int")
    entries = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 11)], "run_id int, org_id int, rank int, candidate_id int")
    sinks.append_shortlists(runs, entries, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "entries")).count() == 2
    for r, e in ((runs, entries.withColumn("rank", F.lit(1))), (runs, entries.withColumn("rank", F.col("rank") + 19)), (runs.withColumn("shortlisted", F.lit(5)), entries)):
        with pytest.raises(ValueError, match="shortlist rules"):
            sinks.append_shortlists(r, e, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_a_failure_between_two_tables_leaves_nothing_readable(spark, tmp_path, monkeypatch):
    runs = spark.createDataFrame([(1, 0, 5, 3, 2)], "run_id long, org_id int, evaluated int, eligible int, shortlisted int")
    entries = spark.createDataFrame([(1, 0, 1, 7), (1, 0, 2, 8)], "run_id long, org_id int, rank int, candidate_id long")
    path, whole, moved = str(tmp_path / "s"), sinks._rename, []

    def broken(session, old, new):
        if moved:
            raise OSError("the driver is lost")
        moved.append(new)
        whole(session, old, new)

    monkeypatch.setattr(sinks, "_rename", broken)
    with pytest.raises(OSError, match="lost"):
        sinks.append_shortlists(runs, entries, path)
    with pytest.raises(ValueError, match="nothing is committed"):
        sinks.read_committed(spark, path, "runs")
    monkeypatch.setattr(sinks, "_rename", whole)
    assert sinks.append_shortlists(runs, entries, path) and not sinks.append_shortlists(runs.repartition(2), entries, path)
    more = runs.withColumn("run_id", F.lit(2).cast("long"))
    assert sinks.append_shortlists(more, entries.withColumn("run_id", F.lit(2).cast("long")), path, batch="epoch-2")
    assert sorted(r.run_id for r in sinks.read_committed(spark, path, "runs").collect()) == [1, 2] and sinks.read_committed(spark, path, "entries").count() == 4
    with pytest.raises(ValueError, match="named by"):
        sinks.append_shortlists(runs, entries, path, batch="../x")
    events = spark.createDataFrame([(1, 0, " x ", -5)], "event_id long, org_id int, model string, total_tokens int")
    assert [sinks.append_events(events, str(tmp_path / "e"), "0") for _ in range(2)] == [True, False]
    assert [(r.model, r.total_tokens) for r in sinks.read_committed(spark, str(tmp_path / "e"), "events").collect()] == [("x", None)]
