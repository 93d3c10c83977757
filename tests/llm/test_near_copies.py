"""The pipeline's near-dedup: planted pairs, crowds, repeated and null ids."""

import random

import numpy as np
import pytest

import corpus_pipeline
from matchloom.llm import near_copies as C

DOCS = "doc_id long, text string"


def jaccard(x, y):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (x, y))
    return len(x & y) / len(x | y)


def changed(rnd, text, n):
    words = text.split()
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"x{rnd.random()}"
    return " ".join(words)


def kept(spark, rows):
    return sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()), key=str)


def test_planted_pairs(spark):
    rnd, rows, want = random.Random(7), [], set()
    for i in range(150):
        text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(300))
        other = changed(rnd, text, 2 + i % 8)
        rows += [(2 * i, text), (2 * i + 1, other)]
        want |= {2 * i} | ({2 * i + 1} if jaccard(text, other) < 0.8 else set())
    assert 150 < len(want) < 250
    assert {i for i, _ in kept(spark, rows)} == want


def test_crowd(spark):
    rnd = random.Random(8)
    text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(300))
    assert kept(spark, [(i, changed(rnd, text, 1)) for i in range(400)])[0][0] == 0
    assert len(kept(spark, [(i, changed(rnd, text, 1)) for i in range(400)])) == 1


def test_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    assert kept(spark, [(1, a), (1, b), (2, a.upper()), (None, b), (None, c), (3, "one two"), (4, "one  TWO"), (5, None), (6, ""), (1, a)]) == sorted(
        [(1, a), (1, b), (None, c), (3, "one two"), (5, None)], key=str
    )


def test_small_bands_over_batches():
    """Bands of up to SMALL members pair all that are alike, wherever batches end; larger ones are passed over."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    kinds = [rng.integers(0, 2**63, 4, dtype=np.uint64).tobytes() for _ in range(80)]
    whole = [(1, 1, kinds[0]), (2, 2, kinds[0]), (2, 3, kinds[0]), (2, 4, kinds[1])] + [(3, 10 + i, kinds[i % 3]) for i in range(50)] + [(4, 100 + i, kinds[5]) for i in range(16)] + [(5, 200 + i, kinds[5]) for i in range(17)] + [(6, 300, kinds[0]), (6, 301, kinds[0])]
    want = {(2, 3), (300, 301)} | {(100 + i, 100 + j) for j in range(16) for i in range(j)}
    for step in (1, 3, 16, 17, 40, 500):
        batches = [pa.RecordBatch.from_pydict(dict(zip(("band", "key", "sketch"), map(list, zip(*whole[i : i + step], strict=True)), strict=True))) for i in range(0, len(whole), step)]
        got = [p for x in C._meet(iter(batches)) for p in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
        assert set(got) == want


@pytest.mark.parametrize(("most", "most_bytes"), [(C.MOST, C.MOST_BYTES), (5, C.MOST_BYTES), (1, C.MOST_BYTES), (C.MOST, 3000), (C.MOST, 0)])
def test_large_bands_join_all_similar_members(most, most_bytes):
    """One band of families and bridges: the links join just what all pairs would, one link a member."""
    import pyarrow as pa
    import zstandard

    rnd, texts = random.Random(3), []
    for _ in range(4):
        base = [f"w{rnd.randrange(9000)}" for _ in range(120)]
        for _ in range(25):
            texts.append(changed(rnd, " ".join(base), rnd.choice([0, 1, 1, 2])))
            base = texts[-1].split() if rnd.random() < 0.3 else base  # families drift
    rnd.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    signed = next(C._sign(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    keys, sketches = signed.column("key").to_pylist(), signed.column("sketch").to_pylist()
    of = dict(zip(keys, texts, strict=True))
    batch = pa.RecordBatch.from_pydict({"band": [1] * len(keys), "key": keys, "sketch": sketches, "packed": [zstandard.compress(of[k].encode()) for k in keys]})
    out = next(C._linker(most, most_bytes)(iter([batch])))
    found = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), out.column("known").to_pylist(), strict=True))
    got = [(a, b) for a, b, known in found if known or jaccard(of[a], of[b]) >= 0.8]
    assert all(jaccard(of[a], of[b]) >= 0.8 for a, b in got)

    def groups(pairs):
        up = {k: k for k in keys}
        def root(k):
            while up[k] != k:
                k = up[k]
            return k
        for a, b in pairs:
            up[root(a)] = root(b)
        return sorted(sorted(k for k in keys if root(k) == r) for r in {root(k) for k in keys})

    if most > len(keys) and most_bytes == C.MOST_BYTES:
        assert len(got) < len(keys)
    assert groups(got) == groups([(a, b) for a in keys for b in keys if a < b and jaccard(of[a], of[b]) >= 0.8])


def test_huge_bands_are_split(spark, monkeypatch):
    rnd = random.Random(4)
    text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(300))
    docs = spark.createDataFrame([(i, changed(rnd, text, 1)) for i in range(80)], DOCS)
    signed = docs.mapInArrow(C._sign, "key long, fp long, bands array<long>, sketch binary")
    whole, split = C.bands(signed)[1], C.bands(signed, 20)[1]
    assert split.count() > 5 * whole.count() > 0


def test_a_family_makes_few_pairs(spark):
    """Pairs of near copies of one text grow with their number, not with its square."""
    rnd = random.Random(3)
    text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(120))
    docs = spark.createDataFrame([(i, changed(rnd, text, 1)) for i in range(1500)], DOCS)
    assert C.links(docs).count() < 40 * 1500  # all pairs are over a million


def test_bounds_of_memory_lose_no_link(spark):
    rnd, rows = random.Random(12), []
    for f in range(3):
        text = " ".join(f"w{rnd.randrange(5000)}" for _ in range(80))
        for i in range(40):
            rows.append((len(rows), text))
            text = changed(rnd, text, 1) if i % 2 else changed(rnd, rows[-(1 + i % 5)][1], 2)
    docs = spark.createDataFrame(rows, DOCS)
    roots = lambda **bounds: sorted((r.root, r.node) for r in C.components(C.links(docs, **bounds)).collect())
    whole = roots()
    assert len(whole) > 60 and whole == roots(most=20, most_bytes=2000, block=30) == roots(most=2, block=25)


def test_members_of_a_huge_band_all_meet(spark):
    """Texts that share one huge band and no other key were parted before."""
    rows = [(k, [7] + [1000 * k + i for i in range(1, C.BANDS)], b"\0" * 32) for k in range(70)]
    large = C.bands(spark.createDataFrame(rows, "key long, bands array<long>, sketch binary"), 20)[1]
    met = {}
    for r in large.collect():
        met.setdefault(r.band, set()).add(r.key)
    assert max(map(len, met.values())) < 70
    assert {(a, b) for m in met.values() for a in m for b in m} == {(a, b) for a in range(70) for b in range(70)}
