"""Signatures and their tree: every field counts, order doesn't, a change reads one bucket; state of the stream."""

import tempfile

import pytest
from pyspark.sql import functions as F

from matchloom.operators import signatures as G
from matchloom.operators import versions as V
from matchloom.streaming import ledgers as T


@pytest.fixture(scope="module")
def tables(spark):
    c = spark.createDataFrame([(i, i % 2, f"n{i}", f"p{i % 3}", "active" if i % 10 else "inactive") for i in range(600)], "candidate_id long, org_id int, full_name string, location string, status string")
    s = spark.createDataFrame([(i, 10 * i + j, f"s{j}", f"label {j}", f"wrote {j}", j, i, i) for i in range(600) for j in range(i % 3)], "candidate_id long, id long, skill string, source_label string, evidence string, years_tenths int, source_document_id long, source_profile_id long")
    p = spark.createDataFrame([(i, i, 1, i, "sha", "x", "remote", "{}") for i in range(0, 600, 2)], "candidate_id long, id long, version int, source_document_id long, source_document_sha256 string, location string, work_mode_preference string, fact_evidence string")
    f = spark.createDataFrame([(i, "language", 0, "German", "speaks it") for i in range(0, 600, 5)], "candidate_id long, rule_type string, pos int, fact string, evidence string")
    return c, s, p, f


def hashes(tables):
    return {r.candidate_id: r.hash for r in G.candidate_hashes(*tables).collect()}


def roots(df):
    return {r.org_id: r.signature for r in G.pool_signature(G.bucket_nodes(G.leaves(df))).collect()}


def test_every_field_of_a_candidate_counts(tables):
    c, s, p, f = tables
    before = hashes(tables)
    assert set(before) == {i for i in range(600) if i % 10} and len(set(before.values())) == len(before)
    other = lambda df, name: df.withColumn(name, F.when(F.col("candidate_id") == 4, F.lit(None)).otherwise(F.col(name)))
    for at, df in enumerate((s, p)):
        for name in df.columns[1:]:
            new = list(tables)
            new[at + 1] = other(df, name)
            after = hashes(new)
            assert [i for i in before if before[i] != after[i]] == [4], name
    for name in ("rule_type", "pos", "fact", "evidence"):
        after = hashes((c, s, p, f.withColumn(name, F.when(F.col("candidate_id") == 5, F.lit(None)).otherwise(F.col(name)))))
        assert [i for i in before if before[i] != after[i]] == [5], name
    assert hashes((other(c, "location"), s, p, f))[4] != before[4]
    assert hashes((c.withColumn("full_name", F.lit("?")), s, p, f)) == before  # contact data don't count


def test_order_and_partitions_do_not_count(tables):
    c, s, p, f = tables
    assert hashes(tables) == hashes((c.orderBy(F.desc("candidate_id")).repartition(3), s.repartition(5), p.repartition(2), f))
    one = roots(G.candidate_hashes(*tables))
    other = roots(G.candidate_hashes(c, s.filter("not (candidate_id = 7 and skill = 's0')"), p, f))
    assert one[0] == other[0] and one[1] != other[1]


def test_a_change_touches_one_bucket(spark, tables):
    c, s, p, f = tables
    top = tempfile.mkdtemp(prefix="spark-")
    before, after = G.candidate_hashes(*tables), G.candidate_hashes(c, s.withColumn("evidence", F.when(F.col("candidate_id") == 77, "corrected").otherwise(F.col("evidence"))), p, f)
    G.save_tree(before, f"{top}/a", 16)
    G.save_tree(after, f"{top}/b", 16)
    a, b = G.read_tree(spark, f"{top}/a"), G.read_tree(spark, f"{top}/b")
    assert [tuple(r) for r in G.changed_buckets(a[1], b[1]).collect()] == [(1, 77 % 16)]
    out = G.tree_changes(a, b)
    assert [tuple(r) for r in out.collect()] == [(1, 77, "changed")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(bucket#" in plan  # other folders aren't read
    assert G.tree_changes(a, a).count() == 0
    # the same tree, brought up to date by the change alone
    old, new = (x.filter("candidate_id = 77").first().hash for x in (before, after))
    moved = spark.createDataFrame([(1, 77, old, new)], "org_id int, candidate_id long, before string, after string")
    show = lambda df: sorted((r.org_id, r.bucket, r.n, r.hash) for r in df.collect())
    assert show(G.update_nodes(a[1], moved, 16)) == show(b[1])
    gone = spark.createDataFrame([(1, 77, old, None), (1, 100_077, None, old)], moved.schema)
    back = spark.createDataFrame([(1, 77, None, old), (1, 100_077, old, None)], moved.schema)
    assert show(G.update_nodes(G.update_nodes(a[1], gone, 16), back, 16)) == show(a[1])


def test_requirements(spark):
    r = spark.createDataFrame([(1, 1, "v1"), (2, 1, "v1"), (3, 1, "v1")], "requirements_id long, version int, schema_version string")
    s = spark.createDataFrame([(1, 5, "s", "must_have", "lab", 0)], "requirements_id long, id long, skill string, importance string, source_label string, position int")
    u = spark.createDataFrame([(2, 7, "language", "equals", "text", None, "German", "german", None, "review", 0)], "requirements_id long, id long, rule_type string, operator string, source_text string, skill_id long, expected string, normalized string, tenths int, unknown_outcome string, position int")
    sign = lambda *t: {x.requirements_id: x.signature for x in G.requirements_signature(*t).collect()}
    before = sign(r, s, u)
    assert set(before) == {1, 2, 3} and None not in before.values()
    for name in s.columns[1:]:
        after = sign(r, s.withColumn(name, F.lit(None).cast(s.schema[name].dataType)), u)
        assert [k for k in before if after[k] != before[k]] == [1], name
    for name in [c for c in u.columns[1:] if c not in ("skill_id", "tenths")]:
        after = sign(r, s, u.withColumn(name, F.lit(None).cast(u.schema[name].dataType)))
        assert [k for k in before if after[k] != before[k]] == [2], name
    for name in ("version", "schema_version"):
        assert all(x != y for x, y in zip(before.values(), sign(r.withColumn(name, F.lit(9).cast(r.schema[name].dataType)), s, u).values(), strict=True))
    runs = spark.createDataFrame([(1, 3, 1, "v1", "s1", before[3], "p", False)], "run_id long, requirements_id long, org_id int, algorithm_version string, snapshot_version string, requirements_signature string, pool_signature string, vacancy_deleted boolean")
    pools = spark.createDataFrame([(1, "p")], "org_id int, signature string")
    assert not V.staleness(runs, G.requirements_signature(r, s, u), pools, "v1", "s1").first().is_stale  # a bare requirement


def test_the_stream_touches_only_candidates_that_came_in(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    schema = "org_id int, candidate_id long, version long, hash string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
    put([(i % 3, i, 0, f"h{i}") for i in range(40)])
    put([(7 % 3, 7, 1, "new"), (7 % 3, 7, 1, "same time"), (2, 8, 0, "old")])
    put([(7 % 3, 7, 2, "new"), (0, 9, 1, None), (0, 9, 1, None)])
    seen = []
    stream = T.changed_in_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"))
    rebuilt = T.refresh_shortlists(lambda orgs: orgs, lambda df, epoch: seen.append((epoch, sorted(r.org_id for r in df.collect()))))
    query = stream.writeStream.foreachBatch(rebuilt).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [(0, [0, 1, 2]), (1, [1]), (2, [0])]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]
    assert [s["numRowsUpdated"] for s in states] == [40, 1, 2] and states[-1]["numRowsTotal"] == 40


def test_carry_forward_copies_children(spark):
    v = spark.createDataFrame([(1, 10, 1, "confirmed", "a"), (1, 11, 2, "confirmed", "b"), (2, 20, 1, "confirmed", "c"), (2, 21, 2, "draft", "d")], "k int, requirements_id int, version int, status string, x string")
    s = spark.createDataFrame([(10, "old"), (11, "one"), (11, "two"), (20, "three")], "requirements_id int, skill string")
    drafts, children = V.carry_forward(v, "k", ["x"], {"skills": s, "rules": s.filter("false")})
    assert [(r.k, r.version, r.status, r.x, r.copied_from) for r in drafts.collect()] == [(1, 3, "draft", "b", 11)]
    assert sorted((r.k, r.version, r.skill) for r in children["skills"].collect()) == [(1, 3, "one"), (1, 3, "two")] and children["rules"].count() == 0
