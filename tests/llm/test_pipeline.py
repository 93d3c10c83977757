"""The pipeline against its stages worked by hand, and on odd rows."""

import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from matchloom.llm import bpe, decontamination, quality_classifier, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else frozenset()


def one_of_each(rows):
    """Rows of the smallest doc_id of each component of texts with a similarity of 0.8 or more."""
    sets = [shingles(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                up[root(i)] = root(j)
    best = defaultdict(list)
    for i, r in enumerate(rows):
        best[root(i)].append((r["doc_id"] is None, r["doc_id"] or 0, i))
    return [rows[min(x)[2]] for x in best.values()]


def test_run_equals_the_stages_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality_classifier.score(docs, model).filter(f"score >= {quality_classifier.THRESHOLD}").select("doc_id").collect()}
    rows = one_of_each([r.asDict() for r in docs.collect() if r.doc_id in good])
    bad = {r.doc_id for r in decontamination.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    rows = [r | {"text": secrets.masked(r["text"] or "")} for r in rows if r["doc_id"] not in bad]
    library = Tokenizer.from_file(bpe.default_tokenizer())
    library.no_truncation(), library.no_padding()
    want = {}
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"]] = (r["lang"], r["source"], len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))
    assert 0 < len(bad) and len(want) < docs.count()
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.lang, r.source, r.n_tokens, bytes(r.ids), r.decoded) for r in got} == want and len(got) == len(want)


ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 44), (2, "alpha beta gamma delta epsilon zeta eta theta", None, None, None), (None, None, None, None, None), (None, "", "en", "s", 0),
    (3, "password = hunter2hunter2", "en", "s", 25), (3, "password = hunter2hunter2", "en", "s", 25), (3, "another text of the same id", "en", "s", 27), (4, "w " * 30_000, "en", "s", 60_000),
]


@pytest.mark.parametrize(("stage", "rows"), [("benchmark decontamination", 8), ("SimHash near-dedup", 5), ("secret scan", 8), ("BPE encoding and decoding", 8)])
def test_stages_on_odd_rows(spark, sf, stage, rows):
    """Nulls, empty and long texts, repeated rows and ids: each stage has its result, and no stage falls over."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf).collect()
    assert len(got) == rows
    if stage == "secret scan":
        assert sorted(r.text for r in got if r.doc_id == 3) == ["another text of the same id", f"password = {secrets.MASK}", f"password = {secrets.MASK}"]
        assert [r.text for r in got if r.doc_id is None] in ([None, ""], ["", None])


def test_quality_stage_on_odd_rows(spark, sf):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality(spark, docs, sf)
    assert got.columns == docs.columns and got.count() <= len(ODD)
