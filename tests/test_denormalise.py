"""Rows with the columns of their parents, however many rows share one."""

from pyspark.sql import functions as F

from matchloom.operators import review as R


def test_a_hot_parent_goes_to_several_tasks(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, F.lit(-5)).otherwise(F.lit(7)).alias("ref"))
    parent = spark.createDataFrame([(7, "seven"), (8, "eight")], "p_key int, p_name string")
    got = R._with_parent(rows, parent, "ref", "p_key", most=50)
    assert got.columns == ["id", "ref", "p_key", "p_name"]
    assert sorted((r.id, r.p_name) for r in got.collect()) == [(i, "seven" if i % 4 > 1 else None) for i in range(1000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan


def test_parents_of_parents_meet_parents_first(spark):
    """The organisation joins candidates, not entries, whose keys of it are few and hot."""
    entries = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 99), (5, None)], "entry_id int, candidate_id int")
    candidates = spark.createDataFrame([(10, 1), (11, 2)], "key int, org int")
    orgs, areas = spark.createDataFrame([(1, "one", 5)], "id int, slug string, area int"), spark.createDataFrame([(5, "south")], "id int, name string")
    df = R.denormalise(entries, {"candidate": (candidates, "candidate_id", "key"), "org": (orgs, "candidate_org", "id"), "area": (areas, "org_area", "id")})
    assert df.columns == ["entry_id", "candidate_id", "candidate_key", "candidate_org", "org_id", "org_slug", "org_area", "area_id", "area_name"]
    assert sorted(tuple(r)[::8] for r in df.collect()) == [(1, "south"), (2, "south"), (3, None), (4, None), (5, None)]
