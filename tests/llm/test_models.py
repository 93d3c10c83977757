"""op4, op7, op9: models against brute force and on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import features as X
from matchloom.llm import ngram_quality as N
from matchloom.llm import quality_classifier as Q
from matchloom.llm import toxicity as T
from matchloom.llm.textkit import Words

DOCS = "doc_id long, text string, lang string, n_chars long, score string, bits int"


def slow_model(texts, order=4):
    counts = {order: Counter()}
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        for i in range(order - 1, len(b)):
            counts[order][b[i - order + 1 : i + 1]] += 1
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discounts = {}
    for m, c in counts.items():
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = []
        for k, plain in ((1, 0.5), (2, 1.0), (3, 1.5)):
            x = k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else plain
            d.append(max(0.05, min(k - 0.05, x)))
        discounts[m] = d
    dis = lambda m, v: discounts[m][min(v, 3) - 1]
    total, freed = defaultdict(float), defaultdict(float)
    for m, c in counts.items():
        for g, v in c.items():
            total[(m, g[:-1])] += v
            freed[(m, g[:-1])] += dis(m, v)

    def p(m, g):
        if m == 0:
            return 1 / 256
        h = (m, g[:-1])
        if h not in total:
            return p(m - 1, g[1:])
        v = counts[m][g]
        return (v - dis(m, v) if v else 0) / total[h] + freed[h] / total[h] * p(m - 1, g[1:])

    return p


def test_kneser_ney_equals_brute_force(spark):
    texts = ["the cat sat on the mat " * 2, "a cat and a hat, the end", "été à la plage", "", "aaaa"]
    docs = spark.createDataFrame([(i, t, "x", 0, "s", 1) for i, t in enumerate(texts)], DOCS)
    p = slow_model(texts)
    got = {r.doc_id: r.bits for r in N.score(docs).collect()}
    for i, t in enumerate(texts):
        b = b"\0\0\0" + t.encode()
        assert got[i] == pytest.approx(-sum(math.log2(p(4, b[j - 3 : j + 1])) for j in range(3, len(b))), rel=1e-5, abs=1e-9)
    models = N.pack(N.estimate(N.count(docs)).toArrow())
    grams = [b"zzzz", b"the ", b"xthe", b" caz", b"\xff\xfe\xfd\xfc"]
    got = N.mixed(models, "x", np.array([int.from_bytes(g, "big") for g in grams], np.uint32))
    assert got == pytest.approx([math.log2(p(4, g)) for g in grams], rel=1e-4)
    for h in (b"the", b"\0\0\0", b"qqq"):  # probabilities of all bytes sum to one
        g = np.array([int.from_bytes(h + bytes([c]), "big") for c in range(256)], np.uint32)
        assert sum(2 ** N.log_probabilities(models[0], "x", g)) == pytest.approx(1, abs=1e-4)


def plain_reference(text):
    n, chars, symbols, _, again = slow_base(text)
    return n >= 50 and 2 * again <= n and 10 * symbols <= n and 5 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) <= chars


def odd_corpus():
    """Texts of three languages: prose, shouted and symbol-ridden ones, loops, short, null and repeated rows."""
    rnd, rows = random.Random(6), []
    say = lambda stems, n: " ".join("".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    stems = {"en": ["the", "re", "ing", "at", "on"], "fr": ["é", "le", "ou", "ment"], "": ["xa", "yo"]}
    for i in range(120):
        lang = rnd.choice(list(stems))
        text = say(stems[lang], rnd.randint(40, 90))
        kind = rnd.random()
        rows.append((i, text.upper() if kind < 0.1 else text.replace(" ", "%% ") if kind < 0.2 else text, None if lang == "" and i % 2 else lang))
    return rows + [(200, None, "en"), (201, "", "zz"), rows[3], rows[3], (None, rows[5][1], rows[5][2]), (202, "ONLY SHOUTED " * 2 + " ".join(f"W{i}" for i in range(60)), "qq")]


@pytest.mark.parametrize("most", [N.MOST_ENTRIES, 1])
def test_bits_bands_and_verdicts_equal_brute_force(spark, most):
    rows = odd_corpus()
    every = {x: slow_model([t or "" for _, t, y in rows if (y or "") == x]) for x in {y or "" for _, _, y in rows}}
    chosen = {x: [t for _, t, y in rows if (y or "") == x and t and plain_reference(t)] for x in every}
    assert chosen["en"] and not chosen["qq"]
    best = {x: slow_model(t) if t else None for x, t in chosen.items()}
    want = {}
    for _, t, y in rows:
        y, b = y or "", b"\0\0\0" + (t or "").encode()
        p = [(every[y](4, b[j - 3 : j + 1]), best[y] and best[y](4, b[j - 3 : j + 1])) for j in range(3, len(b))]
        want[t, y] = -sum(math.log2(N.ALL * a + (1 - N.ALL) * r if best[y] else a) for a, r in p)
    got = N.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_entries=most).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault((r.doc_id, r.lang), []).append(r)
    per = defaultdict(list)
    for i, t, y in rows:
        n, *_, again = slow_base(t or "")
        failed = n < 50 or 100 * again > 50 * n
        assert all(r.base_failed == failed for r in of[i, y])
        assert any(r.bits == pytest.approx(want[t, y or ""], rel=1e-5, abs=1e-9) for r in of[i, y])
        if not failed:
            per[y or ""].append(want[t, y or ""] / len(t.encode()))
    for r in got:
        if not r.n_bytes or (r.lang or "") not in per:
            assert r.kept == (not r.base_failed)
            continue
        xs = sorted(per[r.lang or ""])
        q1, q2, q3 = (xs[math.ceil(f * len(xs)) - 1] for f in (0.25, 0.5, 0.75))
        noise = max((q3 - q1) / 1.349, 1e-3) * math.sqrt(1 + N.NOISE_BYTES / r.n_bytes)
        assert (r.low, r.high) == pytest.approx((q2 - N.WIDTH_LOW * noise, q2 + N.WIDTH_HIGH * noise), rel=1e-4)
        assert r.kept == (not r.base_failed and r.low <= r.bits_per_byte <= r.high)


def test_rounds_of_languages():
    assert N.rounds([("b", 5), ("a", 4), ("c", 20)], 9) == [["a", "b"], ["c"]]
    assert N.rounds([], 9) == []


def slow_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_base_rules(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["", "\n\n \n", "a b c a b c", "x\nx\n x\nx", "é*é é*é é*é é*é"]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        _, got = N.base_rules(pa.RecordBatch.from_arrays([pa.array(part)], ["text"]))
        assert list(zip(*[got[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True)) == [slow_base(t) for t in part]


def test_quality_bands(spark):
    base = "the quick brown fox jumps over lazy dogs while seven wizards mix potions in a quiet hall"
    words = base.split()
    rows = [(i, " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] + str(j) for j in range(80)), "en", 0, "s", 1) for i in range(80)]
    rng = np.random.default_rng(4)
    odd = "".join(chr(33 + c) + (" " if i % 9 == 0 else "") for i, c in enumerate(rng.integers(0, 90, 1200)))
    rows += [(1000, odd, "en", 0, "s", 1), (1001, None, None, None, None, None), (1002, "", "zz", 0, "s", 1), (1003, "short", "en", 0, "s", 1), (1003, "short", "en", 0, "s", 1)]
    got = N.score(spark.createDataFrame(rows, DOCS)).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows) and sum(kept[i] for i in range(80)) == 80 and not any(kept[i] for i in range(1000, 1004))
    odd_row = next(r for r in got if r.doc_id == 1000)
    assert not odd_row.base_failed and odd_row.bits_per_byte > odd_row.high
    assert N.score(spark.createDataFrame([], DOCS)).count() == 0


def auc(pos, neg):
    pos, neg = np.array(pos), np.array(neg)
    return ((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2)


def test_factorisation_machine_margin():
    rng = np.random.default_rng(1)
    size = Q.BUCKETS + 2 * Q.BINS
    model = Q.Model(np.zeros((2, Q.BINS - 1)), 0.3, rng.normal(size=size), rng.normal(size=(size, Q.FACTORS)))
    ids, val, first = np.array([1, 5, 9, 2]), np.array([0.5, 2.0, 1.0, 3.0]), np.array([0, 3, 3, 4])
    got = Q.margins(model, first, ids, val)
    for r, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        z = model.bias + sum(model.weight[i] * x for i, x in zip(ids[a:b], val[a:b], strict=True))
        z += sum(model.factor[ids[i]] @ model.factor[ids[j]] * val[i] * val[j] for i in range(a, b) for j in range(i + 1, b))
        assert got[r] == pytest.approx(z)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op7_quality(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(label[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in label]
    assert auc([s for y, s in held if y], [s for y, s in held if not y]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = T.op9_toxicity(spark, sf).collect()
    held = [(label[r.doc_id], r.severity) for r in got if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert auc([s for y, s in held if y], [s for y, s in held if not y]) > 0.95
    assert all(0 <= r.severity <= T.GRADES - 1 and r.grade in range(T.GRADES) for r in got)


def test_models_without_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", None, "clash", 1), (2, "", "en", 0, "clash", 1), (None, "a b", None, 3, "c", 2), (1, "a b", "en", 3, "c", 2)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    odd = spark.createDataFrame([(1, None, None, "x"), (None, 1, 1, "x"), (2, 7, 7, "x"), (1, 1, 0, "x"), (1, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    for labels in (none, odd):
        model = Q.train(docs, labels)
        assert Q.score(docs, model).count() == 4 and Q.score(docs.limit(0), model).count() == 0
        assert Q.score(docs, model, reject_below=0.0).columns == docs.columns
        tox = T.score(docs, T.train(docs, labels)).collect()
        assert len(tox) == 4 and not any(r.toxic for r in tox)
    assert all(r.score == 0.5 for r in Q.score(docs, Q.train(docs, none)).collect())


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(0)
    ids = [np.sort(rng.choice(200, 20, replace=False)).astype(np.int32) for _ in range(300)]
    data = {"label": [int(3 in i) for i in ids], "ids": ids, "times": [np.ones(20, np.float32)] * 300, "stats": []}
    model = T.fit(data)
    assert (np.diff(model.thetas) > 0).all()


def test_statistics():
    w = Words(pa.array(["AB cd\n!! x", None, "a a a a"]))
    s = X.statistics(w, w.hashes())
    at = dict(zip(X.STATISTICS, s.T, strict=True))
    assert at["distinct"].tolist() == [1.0, 0.0, 0.25] and at["same_as_before"].tolist() == [0.0, 0.0, 0.75] and at["upper_words"].tolist() == [0.25, 0.0, 0.0] and at["repeated_windows"].tolist() == [0.0, 0.0, 1.0]


def test_gradient_of_the_ordinal_likelihood():
    """The gradient that fitting follows equals finite differences of the loss."""
    rng = np.random.default_rng(8)
    first = np.array([0, 3, 5, 9, 12, 14])
    where, x = rng.integers(0, 6, 14), rng.random(14) + 0.2
    grade = np.array([0, 1, 2, 3, 0])
    par = np.concatenate([rng.normal(size=6), [0.4, -0.3, 0.2]])

    def slow(par):
        w, gap = par[:6], par[6:]
        cuts = [-math.inf, gap[0], gap[0] + math.exp(gap[1]), gap[0] + math.exp(gap[1]) + math.exp(gap[2]), math.inf]
        sig = lambda z: 0.0 if z == -math.inf else 1.0 if z == math.inf else 1 / (1 + math.exp(-z))
        out = 0.5 * 1e-3 * (w**2).sum()
        for r, g in enumerate(grade):
            s = sum(w[where[i]] * x[i] for i in range(first[r], first[r + 1]))
            out -= math.log(sig(cuts[g + 1] - s) - sig(cuts[g] - s)) / len(grade)
        return out

    loss, grad = T.loss_and_gradient(par, 6, where, x, first, grade, 1e-3)
    assert loss == pytest.approx(slow(par))
    for k in range(len(par)):
        step = np.zeros(len(par))
        step[k] = 1e-5
        assert grad[k] == pytest.approx((slow(par + step) - slow(par - step)) / 2e-5, rel=1e-4, abs=1e-8)


def test_toxicity_scores_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    model = T.Model(np.array([0.5, 1.5, 3.0]), rng.normal(size=T.BUCKETS).astype(np.float32))
    texts = ["You, you BAD bad thing!", "", None, "one two three " * 40, "é"]
    got = {r.doc_id: r for r in T.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        sparse = T.word_counts(pa.array([t or ""]))
        n = sum(sparse.times.tolist())
        s = sum(model.weight[b] * (1 + math.log(c)) * (n / 100 + 1) ** -0.5 for b, c in zip(sparse.ids.tolist(), sparse.times.tolist(), strict=True))
        above = [1 - 1 / (1 + math.exp(-(h - s))) for h in model.thetas]
        p = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert got[i].severity == pytest.approx(sum(above), abs=1e-6) and got[i].p_toxic == pytest.approx(above[0], abs=1e-6)
        assert got[i].grade == p.index(max(p)) and got[i].toxic == (above[0] >= T.THRESHOLD)
