"""op1: fingerprints, segments, links, crowded keys and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import simhash as S
from matchloom.llm.components import components

DOCS = "doc_id long, text string, fp string, salt int"


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1c\u2003Ω", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_long_text():
    text = " ".join(str(i % 977) for i in range(40_000))
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)


def test_segments_cover():
    assert S.covers(S.BLOCKS, S.SEGMENTS, 4) and S.covers((22, 21, 21), ((0,), (1,), (2,)), 4)
    assert not S.covers((32, 32), ((0,), (1,)), 4) and not S.covers(S.BLOCKS, S.SEGMENTS[:3], 4)
    assert sum(S.BLOCKS) == 64 and len(set(S.masks())) == sum(S.BLOCKS[b] for s in S.SEGMENTS for b in s)


def brute(fps, distance=4):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(u):
        for y in u[i + 1 :]:
            if (x ^ y).bit_count() <= distance:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in u}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def partition(pairs):
    by = {}
    for k, v in pairs:
        by.setdefault(v, set()).add(k)
    return {frozenset(v) for v in by.values()}


@pytest.mark.parametrize("crowd", [4096, 6])
def test_links(spark, crowd):
    rnd = random.Random(crowd)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rnd.choice(fps)
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            x ^= 1 << b
        fps.append(x)
    df = spark.createDataFrame([(signed(x),) for x in set(fps)], "fp long")
    roots = {r.node: r.root for r in components(S.links(df, crowd=crowd)).collect()}
    got = partition((x, roots.get(signed(x), signed(x))) for x in set(fps))
    assert got == partition(brute(fps).items())


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 6)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(201)}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base + " tail"), (9, base.upper()), (2, None), (8, ""), (4, "one two"), (4, "one two"), (None, base), (7, "x " * 50_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    fps = [slow_fingerprint(t or "") for _, t in rows]
    roots = brute(fps)
    want = []
    for (i, _), f in zip(rows, fps, strict=True):
        low = min((d for (d, _), g in zip(rows, fps, strict=True) if roots[g] == roots[f] and d is not None), default=None)
        want.append((i, f"{f:016x}", low))
    assert got == sorted(want, key=str)


def test_empty_and_keep_one(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    base = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(5, base, "a", 1), (3, base, "b", 1), (3, base, "b", 1), (1, "other text here now", "c", 2), (None, "q r s t", "d", 3)], DOCS)
    got = S.keep_one(df)
    assert got.columns == df.columns and sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, None]


def test_forest_is_connected():
    rnd = random.Random(3)
    x = rnd.getrandbits(64)
    fps = np.unique(np.array([x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(80)], np.uint64))
    edges = S._forest(fps, 4)
    assert len(edges) == len(fps) - 1 and all((a ^ b).bit_count() <= 4 for a, b in edges)
