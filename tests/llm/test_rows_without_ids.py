"""Rows with null or repeated ids are told apart by their texts, however large the benchmark."""

import pytest

from matchloom.llm import decontamination as D
from matchloom.llm import simhash as S

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("most", [3, D.MOST_SEEDS])
def test_decontamination(spark, most):
    item = " ".join(f"b{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"x {item} y"), (None, "clean words only in this one here"), (7, item), (7, "other clean words of this one here"), (8, item), (8, item), (9, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id for r in D.overlaps(docs, bench, most=most).collect()), key=str) == [7, 8, 8, None]
    assert sorted(map(tuple, D.drop_contaminated(docs, bench, most=most).collect()), key=str) == sorted([rows[1], rows[3], rows[6]], key=str)


def test_keep_one(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(300)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} tail"), (2, b), (None, b), (None, "q r s t")]
    assert sorted(map(tuple, S.keep_one(spark.createDataFrame(rows, DOCS)).collect()), key=str) == sorted([rows[0], rows[1], rows[5]], key=str)
