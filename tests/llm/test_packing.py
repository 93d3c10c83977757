"""op13: every piece once, sequences within bounds, close to the proven least number."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from matchloom.llm import packing as P
from matchloom.llm.bpe import default_tokenizer


def fewest(sizes, capacity):
    """By trying set partitions: the least number of bins."""
    best = len(sizes)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best and k < len(sizes):
            return
        if k == len(sizes):
            best = min(best, len(bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                put(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best


def test_bound_and_islands_on_small_cases():
    rnd = random.Random(3)
    for _ in range(120):
        size = [rnd.randint(1, rnd.choice([20, 12, 7])) for _ in range(rnd.randint(1, 9))]
        want = fewest(size, 20)
        assert P.least_bins(np.array(size), 20) <= want
        first = P.evolve(size, [], [], 20, random.Random(0), 0)[0]
        out = P.evolve(size, [], [], 20, random.Random(1), 60)[0]
        assert sorted(i for b in out.bins for i in b) == list(range(len(size)))
        assert all(sum(size[i] for i in b) <= 20 for b in out.bins) and want <= out.fitness[0] <= first.fitness[0]
        again = P._read(out.owners(len(size)).tobytes(), size, 20)
        assert again.fitness == out.fitness


def test_crossover_gains_on_what_best_fit_decreasing_misses():
    # three a bin fit exactly; best fit decreasing pairs them badly
    rnd, size = random.Random(5), []
    for _ in range(40):
        a, b = rnd.randint(26, 49), rnd.randint(26, 36)
        size += [a, b, 100 - a - b] if 100 - a - b > 0 else [50, 50]
    rnd.shuffle(size)
    plain = P.evolve(size, [], [], 100, random.Random(0), 0)[0].fitness[0]
    bred = P.evolve(size, [], [], 100, random.Random(0), 400)[0].fitness[0]
    assert bred < plain


def check(rows, items, capacity):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in rows) == sorted((i is None, i, n) for i, n in items)
    return len(held)


def test_blocks_release_their_emptiest_bins(spark):
    rnd = random.Random(9)
    items = [(rnd.choice([None, 1, 2, i]), rnd.choice([0, 1, 100, rnd.randint(1, 60), rnd.randint(30, 99)])) for i in range(1200)]
    items += [(7, 41)] * 400  # repeated rows
    df = spark.createDataFrame(items, "doc_id long, length long").repartition(5)
    got = P.pack(df, 100, block=64, generations=10).collect()
    used = check(got, items, 100)
    size = [n for _, n in items]
    in_one = P.evolve(size, [], [], 100, random.Random(0), 0)[0].fitness[0]  # best fit decreasing over all items at once
    assert used <= 1.02 * in_one
    assert P.pack(df.limit(0), 100).count() == 0
    with pytest.raises(PySparkException):
        P.pack(spark.createDataFrame([(1, 101)], "doc_id long, length long"), 100).count()
    with pytest.raises(PySparkException):
        P.pack(spark.createDataFrame([(1, None)], "doc_id long, length long"), 100).count()


def test_pieces_and_sequences(spark):
    rows = [("a", "one two three " * 40, 1), ("a", "one two three " * 40, 1), (None, None, 2), ("b", "", 3), ("c", "x" * 3000, 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, Length long")
    packed = P.pack(P.pieces(df, 50, ids=True), 50)
    got = packed.collect()
    whole = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 50 * r.piece
    for r in sorted(got, key=lambda r: r.piece):
        whole.setdefault(r.doc_id, []).append(r.ids)
    assert b"".join(whole["b"]) == struct.pack("<I", 0) and b"".join(whole[None]) == struct.pack("<I", 0)
    made = {r.sequence_id: bytes(r.ids) for r in P.sequences(packed).collect()}
    for r in got:
        assert made[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_query(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.no_truncation()
    t.no_padding()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.op13_packing(spark, sf).collect()
    held = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in docs.items()}
    want = [(i, n, 2048 * n, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for i, x in held.items() for n, c in enumerate(itertools.batched(x, 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = check(got, [(w[0], w[3]) for w in want], 2048)
    assert used <= P.least_bins(np.array([w[3] for w in want]), 2048) * 1.01 + 1
