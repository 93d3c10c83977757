"""Columns whose names clash, and words that a polynomial hash would take for each other."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import bpe, decontamination, near_copies, ngram_quality, quality_classifier, secrets, sharding, simhash, substring_dedup, textkit, toxicity


def odd(spark, rows, kind="doc_id long, text string, lang string, source string, n_chars long"):
    """rows with columns that differ only in case, that operators use themselves, that hold a struct, or need quoting."""
    df = spark.createDataFrame(rows, kind)
    more = {"Text": "'other'", "DOC_ID": "-5L", "_copy": "1", "_salt": "2", "_key": "3", "_row": "4", "salt": "5", "s": "named_struct('text', 'x', 'doc_id', 9)", "a`b": "6", "Score": "0.5"}
    return df.selectExpr("*", *[f"{v} AS `{k.replace('`', '``')}`" for k, v in more.items()])


TEXT = " ".join(f"word{i}" for i in range(80))
ROWS = [(1, TEXT, "en", "s", len(TEXT)), (2, TEXT + " end", "en", "s", 9), (3, "token = abcdefgh12345", None, None, None), (4, None, "en", "s", 0), (None, "", "", "", 1), (4, "x y", "en", "s", 3), (4, "x y", "en", "s", 3)]
BENCH = [(7, " ".join(f"q{i}" for i in range(30)))]
LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 1)]


@pytest.mark.parametrize("name", ["simhash", "secrets", "overlaps", "ngrams", "repeats", "bpe", "shards", "toxic", "score"])
def test_clashing_columns_change_nothing(spark, name):
    bench, labels = spark.createDataFrame(BENCH, "item_id long, text string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    run = {
        "simhash": simhash.near_duplicates, "secrets": secrets.scan, "overlaps": lambda d: decontamination.overlaps(d, bench), "ngrams": ngram_quality.score,
        "repeats": substring_dedup.remove_repeats, "bpe": lambda d: bpe.encode(d, keep=("doc_id",)), "shards": sharding.shard,
        "toxic": lambda d: toxicity.score(d, toxicity.train(d, labels)), "score": lambda d: quality_classifier.score(d, quality_classifier.train(d, labels)).toDF(*[f"c{i}" for i in range(len(d.columns) + (1 if "Score" in d.columns else 2))]).select("c0", F.col(f"c{len(d.columns) + (0 if 'Score' in d.columns else 1)}")),
    }[name]
    clean = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    show = lambda df: sorted(str(tuple(r)) for r in run(df).collect())
    assert show(odd(spark, ROWS)) == show(clean)


@pytest.mark.parametrize("name", ["simhash", "near", "drop", "mask"])
def test_all_columns_stay(spark, name):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    run = {"simhash": simhash.keep_one, "near": near_copies.keep_one, "drop": lambda d: decontamination.drop_contaminated(d, bench), "mask": secrets.mask_secrets}[name]
    docs = odd(spark, ROWS)
    got = run(docs)
    assert got.columns == docs.columns
    assert len(got.collect()) == {"simhash": 4, "near": 4, "drop": 7, "mask": 7}[name]


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs.limit(0), sf)
        assert got.columns == docs.columns and not got.collect()
    assert not corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).collect()


def morse(n):
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words(spark, n):
    """These two words hash alike for every polynomial modulo 2**64."""
    x, y = morse(n)
    words = textkit.Words(pa.array([f"{x} {y} {x}"]))
    a, b, c = words.hashes().tolist()
    assert a == c != b
    tail = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()) == [(1, 0), (2, 0), (3, 13)]
    bench = spark.createDataFrame([(5, f"{x} t0 t1 t2 t3")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.overlaps(docs, bench).collect()) == [1, 3]
    many = pa.RecordBatch.from_pydict({"text": [f"{x} k l {y} k l"]})
    assert ngram_quality.base_rules(many)[1]["n_repeat_words"].tolist() == [0]


def test_word_hashes_are_those_of_the_bytes():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 3, rng.integers(1, 40))) for _ in range(200)) for _ in range(5)] + ["z" * 300, "", "z" * 257 + " z" * 3]
    words = textkit.Words(pa.array(texts))
    of = {}
    for h, s, e in zip(words.hashes().tolist(), words.start.tolist(), words.end.tolist(), strict=True):
        assert of.setdefault(words.raw[s:e].tobytes(), h) == h
    assert len(set(of.values())) == len(of)
