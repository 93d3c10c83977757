"""op2, op3, op5: secrets, decontamination and substring removal against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from matchloom.llm import decontamination as D
from matchloom.llm import secrets as C
from matchloom.llm import substring_dedup as R
from matchloom.llm.textkit import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_strict_finds_stay():
    rnd = random.Random(3)
    parts = ["password", "Token=", "api_key : ", 'APIKEY="', "AKIA", "secret'=", "0123456789abcdef", "ABCDEF0123456789", "é", "\n\n", " ", '="', "user=bob ", "https://h.x/y ", "Ab1" * 8, "abcdefg", ":", "="]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        spans = C.scan_text(text)
        assert [(k, s, e) for k, s, e, _ in spans if k in C.KINDS[:3]] == slow_base(text)
        assert spans == sorted(set(spans), key=lambda p: (p[1], C.KINDS.index(p[0]), p[2]))
        weak, ids = [p for p in spans if p[0] == "secret"], [p for p in spans if p[0] in ("identifier", "endpoint")]
        for p in weak:  # brute force: a complementary part near by
            assert any(q[1] <= p[2] + C.GAP and q[2] >= p[1] - C.GAP for q in spans if q[0] in ("identifier", "endpoint", "access"))
        for p in ids:
            assert any(q[1] <= p[2] + C.GAP and q[2] >= p[1] - C.GAP for q in spans if q[0] in ("secret", "assign", "hex"))


def test_linking_needs_both_parts():
    token = "Ab1" * 8
    kinds = lambda t: [k for k, *_ in C.scan_text(t)]
    assert kinds(f"user=bob {token}") == ["identifier", "secret"] and kinds(f"{token} https://db.host:5432/x") == ["secret", "endpoint"]
    assert kinds("user=bob https://db.host/x") == [] and kinds(token) == []
    assert kinds(f"user=bob\n\n{token}") == [] and kinds("user=bob " + "x " * 200 + token) == []


def test_masking(spark):
    assert C.masked('token = "abcdef123456" x') == 'token = "<secret>" x' and C.masked("plain") == "plain"
    df = spark.createDataFrame([(1, "token=abcdef1", 13, "k"), (2, None, None, "k"), (3, "", 0, None)], "doc_id long, text string, n_chars long, spans string")
    assert [tuple(r) for r in C.mask_secrets(df).collect()] == [(1, "token=<secret>", 14, "k"), (2, None, None, "k"), (3, "", 0, None)]
    assert [(r.doc_id, len(r.spans)) for r in C.scan(df).collect()] == [(1, 1), (2, 0), (3, 0)]
    assert C.scan(df.limit(0)).count() == 0


def slow_repeats(rows, n=13):
    low = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            low[k] = min(low.get(k, 1 << 62), 1 << 62 if d is None else d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - n + 1):
            if low[tuple(w[i : i + n])] < (1 << 62 if d is None else d):
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [1 << 21, 40])
def test_substring_removal(spark, bucket):
    rnd = random.Random(1)
    passage = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(n)) for n in (13, 14, 30, 12)]
    rows = []
    for d in range(60):
        parts = [" ".join(rnd.choice(["the", "a", f"x{rnd.randint(0, 400)}"]) for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        parts.insert(rnd.randint(0, 3), rnd.choice(passage))
        rows.append((rnd.randint(0, 50), rnd.choice([" ", "\n", "  "]).join(parts)))
    rows += [(7, None), (8, ""), (None, passage[2]), (None, passage[2]), (3, rows[0][1]), (3, rows[0][1]), (99, "é " * 40), (100, "é " * 40 + passage[1] + " " + passage[1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, answers string")
    got = R.remove_repeats(df, bucket_windows=bucket).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == slow_repeats(rows)
    for r in got:
        assert sum(e - s for s, e in r.removed) == r.n_removed and all(a[1] < b[0] for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_words_of_slices():
    import pyarrow as pa

    texts = ["ab cd", None, "", " x\x0by ", "é\u2003z", "ab"]
    w = Words(pa.array(texts).slice(1))
    got = [[bytes(w.raw[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first, w.first[1:], strict=False)]
    assert got == [WORD.findall(t or "") for t in texts[1:]]
    h = Words(pa.array(["ab ab", "x ab"])).hashes()
    assert h[0] == h[1] == h[3] != h[2]


def slow_tiles(doc, item, least):
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for d in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while d + n < len(doc) and q + n < len(item) and doc[d + n] == item[q + n] and d + n not in used_d and q + n not in used_i:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, d, q)
        if best is None:
            return out
        n, d, q = best
        used_d.update(range(d, d + n))
        used_i.update(range(q, q + n))
        out.append((d, q, n))


def test_tiling_covers_as_the_plain_method_does():
    rnd = random.Random(5)
    for _ in range(150):
        item = [rnd.choice("abcd") for _ in range(rnd.randint(3, 16))]
        doc = [rnd.choice("abcd") for _ in range(rnd.randint(3, 25))]
        pairs = [(d, q) for d in range(len(doc) - 2) for q in range(len(item) - 2) if doc[d : d + 3] == item[q : q + 3]]
        got = D.tile(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), 3, 3) if pairs else []
        assert got == slow_tiles(doc, item, 3)


def test_decontamination(spark):
    rnd = random.Random(2)
    words = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    items = [words(40) for _ in range(5)] + [["a", "b"], []]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(0, " ".join(items[0]), 2), (9, None, 1)], "item_id long, text string, doc_id int")
    half = items[1][20:] + words(5) + items[1][:20]  # reordered
    rows = [(1, " ".join(words(50) + items[0] + words(10))), (2, ", ".join(half).upper()), (3, " ".join(words(200))), (4, " ".join(items[2][:10])), (5, None), (6, ""), (7, " ".join(items[3][:21])), (8, "a b"), (1, " ".join(items[4]))]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 3)) for r in D.overlaps(docs, bench).collect())
    assert got == [(1, 0, 1.0), (1, 4, 1.0), (2, 1, 1.0), (7, 3, 0.525), (8, 5, 1.0)]  # an item of two words is found whole
    assert sorted((r.doc_id, r.item_id, round(r.coverage, 3)) for r in D.overlaps(docs, bench, most=3).collect()) == got
    for most in (10**6, 3):
        clean = D.drop_contaminated(docs, bench, most=most)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    assert D.overlaps(docs, bench.limit(0)).count() == 0 and D.overlaps(docs.limit(0), bench).count() == 0


def test_queries_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in R.op5_substring_dedup(spark, sf).collect()}
    for d, n, gone, kept in slow_repeats(docs):
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    found = {r.doc_id: r for r in C.op2_secrets(spark, sf).collect()}
    for d, t in docs:
        base = slow_base(t or "")
        assert found[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert found[d].n_hex == sum(k == "hex" for k, _, _ in base)


def slow_links(text):
    """Weak parts that are reported, found by looking at all pairs of parts."""
    base = C.strict(text)
    free = lambda parts: [p for p in parts if not any(s < p[2] and p[1] < e for _, s, e, _ in base)]
    weak = free(C.weak_secrets(text))
    ids = free([("identifier", m.start(), m.end(), m.start(1)) for m in C._ACCOUNT.finditer(text)])
    ends = free([("endpoint", m.start(), m.end(), m.start()) for m in C._ENDPOINT.finditer(text)])
    breaks = [m.end() for m in C._BREAK.finditer(text)]
    place = lambda p: sum(b <= p[1] for b in breaks)
    near = lambda p, q: place(p) == place(q) and q[1] <= p[2] + C.GAP and q[2] >= p[1] - C.GAP
    secrets, others = [b for b in base if b[0] != "access"] + weak, [b for b in base if b[0] == "access"] + ids + ends
    return {p for p in weak if any(near(p, q) for q in others)} | {p for p in ids + ends if any(near(p, q) for q in secrets)}


def test_no_link_is_missed():
    rnd, linked = random.Random(11), 0
    for _ in range(300):
        parts = []
        for _ in range(rnd.randint(1, 14)):
            parts.append(rnd.choice([
                "user=alice7", "login: bob", "https://api.example.org/v1", "10.0.0.1:8080", "host.example.com:443", "Abcdefgh1234567890XyZw", "bearer a1b2c3d4e5", "password=hunter22", "AKIA" + "Z9" * 9, "f0" * 14,
                "words " * rnd.randint(1, 90), "\n\n", "\n \t\n", "x" * rnd.randint(1, 400), "B1c" * 120,
            ]))
        text = rnd.choice([" ", "\n"]).join(parts)
        got = {p for p in C.scan_text(text) if p[0] in ("secret", "identifier", "endpoint")}
        assert got == slow_links(text)
        linked += len(got)
    assert linked > 100


def test_many_parts_take_few_steps():
    """A long part doesn't make others look at everything before them."""
    import time

    text = "user=" + "a" * 200_000 + " " + " ".join(f"user{i}=name{i}" for i in range(20_000)) + " " + "Qq1" * 60_000
    start = time.time()
    C.scan_text(text)
    assert time.time() - start < 20
