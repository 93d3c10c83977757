"""Quality rules with an n-gram perplexity band for each language.

The model is an interpolated modified Kneser-Ney model over the bytes of the
text, of order four.  Spark counts the n-grams of all documents; each language's
counts become sorted arrays of 64-bit hashes with log probabilities and back-off
weights in one task, whose size the distinct n-grams of a language bound, not
its text.  Every document is counted, but a model of all texts alone finds
frequent junk as likely as it is frequent, so the probability of a byte mixes
two such models: mostly that of reference texts, and with the weight ALL that of
all.  A document's score is its bits per byte, compared with the band that
robust statistics of its own language span.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import repeats
from .stage import cut, ensure
from .textkit import Words, mix, text_slices

ORDER = 4
#: Weight of the model of all texts beside that of reference texts.
ALL = 1 / 16
#: Entries of all orders that are sent to the executors at once (one language at least); more languages take further rounds.
MOST_ENTRIES = 6_000_000
#: Half width of a band in robust standard deviations, and the bytes at which a text's own noise doubles its variance.
WIDTH_LOW, WIDTH_HIGH, NOISE_BYTES = 4.5, 14.0, 1500.0

_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


class Model(NamedTuple):
    """For each order (4 to 1): sorted hashes with log2 probabilities, sorted hashes of histories with log2 back-off weights."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    histories: list[np.ndarray]
    backoffs: list[np.ndarray]


def _language(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    names = [x or "" for x in texts.to_pylist()]
    known = {n: i for i, n in enumerate(dict.fromkeys(names))}
    return list(known), np.array([known[n] for n in names], np.int64)


def grams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte the ORDER bytes that end with it, packed; zero bytes stand before a text begins."""
    wide = raw.astype(np.uint32)
    out, n = wide.copy(), len(raw)
    begin = np.zeros(n, np.int8)
    length = np.diff(off)
    for j in range(ORDER - 1):
        begin[off[:-1][length > j] + j] = ORDER - 1 - j  # bytes that lie before the text
    for j in range(1, ORDER):
        if n > j:
            out[j:] |= np.where(begin[j:] > ORDER - 1 - j, np.uint32(0), wide[:-j] << np.uint32(8 * j))
    return out


def reference(words: Words, base: dict[str, np.ndarray]) -> np.ndarray:
    """Reference texts: those that pass the base rules and are neither symbol-ridden nor shouted."""
    total = np.concatenate([[0], np.cumsum(_UPPER[words.raw], dtype=np.int64)])
    upper = total[words.off[1:]] - total[words.off[:-1]]
    n = base["n_words"]
    return (n >= 50) & (2 * base["n_repeat_words"] <= n) & (10 * base["n_symbols"] <= n) & (5 * upper <= base["word_chars"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a partition's texts by language, counted before they are shuffled: in all texts and in reference texts."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        key, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return key[start], np.add.reduceat(n, start, axis=0) if len(key) else n

    def rows():
        for name, parts in held.items():
            key, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], ["lang", "gram", "n", "n_ref"])
        held.clear()

    for batch in batches:
        for part in text_slices(batch, "text"):
            words, base = base_rules(part)
            names, lang = _language(part.column("lang"))
            key, size = grams(words.raw, words.off), np.diff(words.off)
            slot, chosen = np.repeat(lang, size), np.repeat(reference(words, base), size)
            for i, name in enumerate(names):
                own = slot == i
                k, at, n = np.unique(key[own], return_inverse=True, return_counts=True)
                parts = held.setdefault(name, [])
                parts.append((k, np.stack([n, np.bincount(at, chosen[own], len(k)).astype(np.int64)], 1)))
                if len(parts) >= 8:
                    held[name] = [merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 4_000_000:
                yield from rows()
    yield from rows()


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n, n_ref) over every text, and over reference texts; null languages are the language ''."""
    rows = ensure(docs, "text", "lang").mapInArrow(_count, "lang string, gram long, n long, n_ref long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_ref").alias("n_ref"))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more; plain values where the counts of counts give none."""
    of = [np.count_nonzero(n == k) for k in range(5)]
    y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
    d = [k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] else plain for k, plain in ((1, 0.5), (2, 1.0), (3, 1.5))]
    return np.clip(d, 0.05, [0.95, 1.95, 2.95])


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1 to ORDER: grams with log2 probabilities, histories with log2 back-off weights.

    Lower orders count the distinct grams that end with theirs (continuation
    counts); the lowest is interpolated with a uniform choice of 256 bytes.
    """
    order = np.argsort(gram)
    tables = {ORDER: (gram[order].astype(np.uint64), n[order])}
    for m in range(ORDER - 1, 0, -1):
        tables[m] = np.unique(tables[m + 1][0] & np.uint64((1 << (8 * m)) - 1), return_counts=True)
    out, below = [], None
    for m in range(1, ORDER + 1):
        g, c = tables[m]
        d = _discounts(c)[np.minimum(c, 3) - 1]
        history, at = np.unique(g >> np.uint64(8), return_inverse=True)
        total, freed = np.bincount(at, c), np.bincount(at, d)
        lower = 1 / 256 if below is None else below[np.searchsorted(tables[m - 1][0], g & np.uint64((1 << (8 * (m - 1))) - 1))]
        below = (c - d) / total[at] + (freed / total)[at] * lower
        out.append((g, np.log2(below), history, np.log2(freed / total)))
    return out


_MODELS = "lang string, which int, level int, keys binary, logs binary, histories binary, backoffs binary, entries long"


def _estimate(table: pa.Table) -> pa.Table:
    """The models of one language (which: 0 all texts, 1 reference texts), a row for each order, hashed and sorted."""
    lang, gram, rows = table.column("lang")[0].as_py(), table.column("gram").to_numpy(), []
    for which, name in enumerate(("n", "n_ref")):
        n = table.column(name).to_numpy()
        if not (n > 0).any():
            continue
        for m, (g, p, h, b) in enumerate(kneser_ney(gram[n > 0], n[n > 0]), 1):
            packed = []
            for key, log in ((_hash(lang, g), p), (_hash(lang, h), b)):
                order = np.argsort(key)
                packed += [key[order].tobytes(), log[order].astype(np.float32).tobytes()]
            rows.append((lang, which, m, *packed, len(g) + len(h)))
    kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64())
    names = [c.split()[0] for c in _MODELS.split(", ")]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})


def estimate(counts: DataFrame) -> DataFrame:
    """Packed models of every language in counts(lang, gram, n, n_ref)."""
    return counts.groupBy("lang").applyInArrow(_estimate, _MODELS)


def _hash(lang: str, gram: np.ndarray) -> np.ndarray:
    return mix(np.uint64(xxhash.xxh64_intdigest(lang.encode())) ^ gram.astype(np.uint64))


def pack(models: pa.Table) -> list[Model]:
    """Packed rows of some languages as two models: of all texts, and of reference texts."""
    rows, out = models.to_pylist(), []
    for which in (0, 1):
        model = Model([], [], [], [])
        for m in range(ORDER, 0, -1):
            own = [r for r in rows if (r["which"], r["level"]) == (which, m)]
            for name, other, keys, logs in (("keys", "logs", model.keys, model.logs), ("histories", "backoffs", model.histories, model.backoffs)):
                key = np.concatenate([np.frombuffer(r[name], np.uint64) for r in own] or [np.zeros(0, np.uint64)])
                log = np.concatenate([np.frombuffer(r[other], np.float32) for r in own] or [np.zeros(0, np.float32)])
                order = np.argsort(key)
                keys.append(key[order])
                logs.append(log[order])
        out.append(model)
    return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return hit, values[at] if len(keys) else np.zeros(len(wanted), np.float32)


def log_probabilities(model: Model, lang: str, gram: np.ndarray) -> np.ndarray:
    """log2 of the probability of each gram's last byte, backing off through shorter histories."""
    out, rest = np.zeros(len(gram)), np.arange(len(gram))
    for i in range(ORDER):
        m = ORDER - i
        g = gram[rest].astype(np.uint64) & np.uint64((1 << (8 * m)) - 1)
        hit, value = _find(model.keys[i], model.logs[i], _hash(lang, g))
        out[rest[hit]] += value[hit]
        rest, g = rest[~hit], g[~hit]
        if not len(rest):
            return out
        seen, weight = _find(model.histories[i], model.backoffs[i], _hash(lang, g >> np.uint64(8)))
        out[rest[seen]] += weight[seen]
    out[rest] += np.log2(1 / 256)
    return out


def mixed(models: list[Model], lang: str, gram: np.ndarray) -> np.ndarray:
    """log2 of the mixed probability of each gram's last byte; a language without reference texts has the model of all its texts alone."""
    every, chosen = models
    p = log_probabilities(every, lang, gram)
    if not _find(chosen.histories[-1], chosen.backoffs[-1], _hash(lang, np.zeros(1, np.uint64)))[0][0]:
        return p
    return np.logaddexp2(np.log2(ALL) + p, np.log2(1 - ALL) + log_probabilities(chosen, lang, gram))


def base_rules(part: pa.RecordBatch) -> tuple[Words, dict[str, np.ndarray]]:
    """The word, symbol, line and repetition counts of each text."""
    words = Words(part.column("text"))
    hashes = words.hashes()
    raw, off = words.raw, words.off

    def per_text(flag: np.ndarray, edge: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[edge[1:]] - total[edge[:-1]]

    separators = np.isin(raw, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    data, lines = raw.tobytes(), []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        some = [x for x in data[a:b].split(b"\n") if x.strip()]
        lines.append(len(some) - len(set(some)))
    return words, {
        "n_words": words.counts(), "word_chars": per_text(((raw & 0xC0) != 0x80) & ~separators, off), "n_symbols": per_text(_SYMBOL[raw], off),
        "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": per_text(repeats(words, hashes), words.first),
    }


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, base = base_rules(part)
                names, lang = _language(part.column("lang"))
                key, slot = grams(words.raw, words.off), np.repeat(lang, np.diff(words.off))
                cost = np.zeros(len(key), np.float32)
                for i, name in enumerate(names):
                    own = slot == i if len(names) > 1 else slice(None)
                    k = key[own]
                    distinct = np.unique(k)
                    value = -mixed(models, name, distinct).astype(np.float32)
                    cost[own] = value[_places(distinct, k)]
                total = np.concatenate([[0.0], np.cumsum(cost, dtype=np.float64)])
                bits = total[words.off[1:]] - total[words.off[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), *[pa.array(base[c].astype(np.int64)) for c in _BASE], pa.array(np.diff(words.off)), pa.array(bits)],
                    ["doc_id", "lang", *_BASE, "n_bytes", "bits"],
                )

    return run


def _places(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in sorted ``distinct`` of each key, by a direct table with the few clashes looked up."""
    size = np.uint32(20)
    spot = lambda k: ((k * np.uint32(2654435761)) >> (np.uint32(32) - size)).astype(np.int64)
    table = np.zeros(1 << int(size), np.int32)
    table[spot(distinct)] = np.arange(len(distinct), dtype=np.int32)
    at = table[spot(keys)]
    wrong = np.flatnonzero(distinct[at] != keys)
    at[wrong] = np.searchsorted(distinct, keys[wrong])
    return at


def rounds(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Languages dealt to rounds of at most ``most`` entries, one language at least."""
    out, full = [], most
    for lang, n in sorted(sizes):
        if full + n > most:
            out.append([])
            full = 0
        out[-1].append(lang)
        full += n
    return out


def _band(scored: DataFrame) -> DataFrame:
    """(lang, middle, spread) of the bits per byte of each language's texts that pass the base rules; quartiles, so junk moves it little."""
    good = scored.filter("not base_failed and n_bytes > 0").withColumn("x", F.col("bits") / F.col("n_bytes"))
    q = good.groupBy("lang").agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 2000).alias("q"))
    return q.select("lang", F.col("q")[1].alias("middle"), F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(1e-3)).alias("spread"))


def score(docs: DataFrame, width: tuple[float, float] = (WIDTH_LOW, WIDTH_HIGH), most_entries: int = MOST_ENTRIES) -> DataFrame:
    """One row for each row of docs: doc_id, lang, base counts, n_bytes, bits, bits_per_byte, low, high, base_failed, kept.

    ``kept`` is false if the base rules fail or bits per byte lie outside the
    language's band.  Every text is counted, and the bands come from all rows that
    pass the base rules.  Null texts are empty and fail; a null language is the
    language ''.  Where a language has no text that passes the base rules, it has
    no band.  Models of more than ``most_entries`` entries go out in rounds of
    languages, with the same results.
    """
    docs = ensure(docs, "doc_id", "text", "lang")
    models = cut(estimate(count(docs)))
    sizes = [(r.lang, r.n) for r in models.groupBy("lang").agg(F.sum("entries").alias("n")).collect()]  # a row a language
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in _BASE)}, n_bytes long, bits double"
    lang, scored, dealt = F.coalesce("lang", F.lit("")), None, rounds(sizes, most_entries) or [[]]
    for some in dealt:
        own = F.col("lang").isin(some)
        sent = docs.sparkSession.sparkContext.broadcast(pack(models.filter(own).toArrow()))
        rows = docs if len(dealt) == 1 else docs.filter(lang.isin(some))
        part = rows.mapInArrow(_scorer(sent), out)
        scored = part if scored is None else scored.unionByName(part)
    if len(dealt) > 1:  # languages that have no byte at all
        scored = scored.unionByName(docs.filter(~lang.isin([x for x, _ in sizes])).mapInArrow(_scorer(sent), out))
    failed: Column = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = cut(scored.withColumn("base_failed", failed))
    bands = cut(_band(scored.withColumn("lang", lang)))
    few = F.broadcast(bands) if bands.count() <= 10_000 else bands.hint("merge")
    few = few.select(F.col("lang").alias("band_lang"), "middle", "spread")
    x = F.col("bits") / F.nullif(F.col("n_bytes"), F.lit(0))
    noise = F.col("spread") * F.sqrt(1 + F.lit(NOISE_BYTES) / F.greatest(F.col("n_bytes"), F.lit(1)))
    rows = scored.join(few, lang == F.col("band_lang"), "left").withColumn("bits_per_byte", x)
    rows = rows.withColumn("low", F.col("middle") - width[0] * noise).withColumn("high", F.col("middle") + width[1] * noise)
    inside = F.coalesce(F.col("bits_per_byte").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).drop("band_lang", "middle", "spread")


def op4_ngram_quality(spark, sf_dir: str) -> DataFrame:
    done = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", *_BASE, "base_failed", "kept", F.round("bits_per_byte", 6).alias("bits_per_byte"))
