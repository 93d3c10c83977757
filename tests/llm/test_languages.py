"""op4: null and empty languages share one band."""

from matchloom.llm import ngram_quality as N


def test_null_and_empty_language(spark):
    rows = [(i, " ".join(f"word{(i * j) % 89}" for j in range(1, 80)), None if i % 2 else "") for i in range(1, 41)]
    assert sorted(r.doc_id for r in N.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()) == list(range(1, 41))
