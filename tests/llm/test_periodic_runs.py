"""op12: runs against the definition, on random and hostile word sequences."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from matchloom.llm import periodic_runs as R


def brute(w: list) -> list[tuple[int, int, int]]:
    """Every stretch with smallest period q, long enough, that can't grow."""
    found, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            own = w[i : i + size]
            if size >= max(6, 4 * q) and not any(all(own[k] == own[k + p] for k in range(size - p)) for p in range(1, q)):
                found.add((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs(w: list, text=None) -> list[tuple[int, int, int]]:
    word = np.unique(np.array(w), return_inverse=True)[1] if w else np.zeros(0, np.int64)
    return [tuple(map(int, r)) for r in R.find_runs(word, np.zeros(len(w), np.int64) if text is None else text)]


def sequences():
    rnd = random.Random(7)
    for _ in range(400):
        kinds = rnd.choice([1, 2, 3, 4, 8, 30])
        w = []
        while len(w) < rnd.randint(0, 240):
            unit = [rnd.randrange(kinds) for _ in range(rnd.randint(1, 40))]
            w += unit * rnd.choice([1, 1, 3, 4, 5, 9]) + unit[: rnd.randrange(len(unit) + 1)]
        yield w
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [bin(i).count("1") % 2 for i in range(512)]


def test_runs_equal_the_definition():
    for w in sequences():
        assert runs(w) == brute(w), w


def test_work_bound_of_splitting_changes_nothing(monkeypatch):
    monkeypatch.setattr(R, "SPLIT_WORK", 0)
    for w in list(sequences())[::5]:
        assert runs(w) == brute(w), w


def test_every_lag_is_found():
    for q in range(1, 90):
        unit = list(range(q))
        assert runs([-1, *unit * 4, -2]) == ([(1, 4 * q, q)] if q > 1 else [])
        assert runs([*unit * 4][:-1]) == []


def test_texts_do_not_mix():
    word, text = np.array([1] * 5 + [1] * 6 + [2] * 3 + [2] * 3), np.array([0] * 5 + [1] * 6 + [2] * 3 + [3] * 3)
    assert R.find_runs(word, text).tolist() == [[5, 6, 1]]


@pytest.mark.parametrize("make", [lambda n: [0] * n, lambda n: [i % 3 for i in range(n)], lambda n: [i % (n // 4) for i in range(n)], lambda n: [random.Random(i // 4).randrange(50) for i in range(n)], lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: [x for k in range(n // 8) for x in [k] * 4 + [0] * 4]])
def test_long_texts_take_little_time(make):
    w = make(200_000)
    began = time.time()
    runs(w)
    assert time.time() - began < 20


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a " * 9, "y"), (None, "a " * 9, "y"), (4, "b\ta\na b a b\x0ba b a\x0c\rc", "z"), (5, "é " * 5 + "é", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Text2 string")
    got = R.periodic_runs(df).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(1, [], ""), (2, [], ""), (None, [(0, 9, 1)], "a"), (None, [(0, 9, 1)], "a"), letters(), (5, [(0, 6, 1)], "é")]
    assert R.periodic_runs(df.limit(0)).count() == 0
    assert R.periodic_runs(df.selectExpr("'k' AS doc_id", "text", "text AS TEXT2")).count() == len(rows)


def letters():
    w = "b a a b a b a b a c".split()
    want = brute(w)
    gone = {k for s, n, q in want for k in range(s + q, s + n)}
    return 4, want, " ".join(x for k, x in enumerate(w) if k not in gone)


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in R.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        w, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        n = len(w)
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want, r = brute(w), got[d.doc_id]
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        gone = {k for s, size, q in want for k in range(s + q, s + size)}
        assert r.n_runs == len(want) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
        seen += len(want)
    assert seen > 5
