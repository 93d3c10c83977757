"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and freed of punctuation.  Karp-Rabin hashes of five
consecutive words ("seeds") that a document shares with a test item are joined;
seeds in a row on one diagonal make a match.  Only pairs at which a match begins or
ends are made, those whose words before, or after, the seed differ: a word that
stands n times in one text and m times in the other makes n + m pairs, not n x m.
Tiling takes the longest match
whose words are unmarked in both texts, marks it, and goes on with what is left
of the others until none reaches the least length.  A document is contaminated
by an item if its tiles cover enough of the item's words, in whatever order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import join_hot
from .stage import by_position, ensure
from .textkit import Words, mix, text_slices

SEED = 5
COVERAGE = 0.5
#: Seeds of the benchmark that are sent to the executors at most; more are joined by shuffles.
MOST_SEEDS = 2_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[np.frombuffer(b".,;:!?\"'()[]{}*#%&$|<>-_/\\", np.uint8)] = 0x20

_TILE = "array<struct<doc_start:long,item_start:long,length:long>>"


class Edges(NamedTuple):
    """Seeds of items sorted by hash, then by the word beside them (before or after), and where each stands; runs of equal hash and word by one key."""

    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    keys: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Index(NamedTuple):
    """Items' ids and lengths, their seeds by the word before and by the word after, and items shorter than a seed by the hash of all their words."""

    starts: Edges
    ends: Edges
    whole: np.ndarray
    whole_item: np.ndarray
    ids: list
    lengths: np.ndarray


def _side_key(h: np.ndarray, beside: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(beside))


def edges(h: np.ndarray, item: np.ndarray, place: np.ndarray, beside: np.ndarray) -> Edges:
    order = np.lexsort((beside, h))
    h, item, place, beside = h[order], item[order], place[order], beside[order]
    low = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (beside[1:] != beside[:-1])]) if len(h) else np.zeros(0, np.int64)
    key, high = _side_key(h[low], beside[low]), np.r_[low[1:], len(h)] if len(h) else low
    by_key = np.argsort(key)
    return Edges(h, item, place, key[by_key], low[by_key], high[by_key])


def _unlike(found: Edges, h: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For seeds of documents all seeds of items with the same words but another word beside them: indexes of both."""
    low, high = np.searchsorted(found.seeds, h, "left"), np.searchsorted(found.seeds, h, "right")
    key = _side_key(h, beside)
    at = np.minimum(np.searchsorted(found.keys, key), max(len(found.keys) - 1, 0))
    same = found.keys[at] == key if len(found.keys) else np.zeros(len(h), bool)
    cut_low, cut_high = (np.where(same, x[at], high) if len(x) else high for x in (found.low, found.high))
    begin, size = np.r_[low, cut_high], np.r_[cut_low - low, high - cut_high]
    own = np.repeat(np.tile(np.arange(len(h)), 2), size)
    return own, np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


#: Words beside the first and the last seed of a document, of an item: none equals any.
_NO_WORD = (np.uint64(0x6E6F6E6520646F63), np.uint64(0x6E6F6E6520697465))


def beside(words: Words, owner: np.ndarray, place: np.ndarray, seed: int, none: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words before and after each seed."""
    hashes, first = words.hashes(), words.first[owner] + place
    last = place + seed >= words.counts()[owner]
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.where(place == 0, none, hashes[np.maximum(first - 1, 0)]), np.where(last, none, hashes[np.minimum(first + seed, len(hashes) - 1)])


def seeds(texts: pa.Array, seed: int = SEED, short: tuple[int, ...] = (), whole: bool = False) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the folded texts; for each seed its hash, its text and its first word within the text.

    ``short`` adds windows of fewer words, with ``whole`` only of texts that have no more.
    """
    words = Words(texts, _FOLD)
    hashes = words.hashes()
    h, first = words.windows(hashes, seed)
    parts = [(h, first)]
    for n in short:
        h, first = words.windows(hashes, n)
        if whole and len(h):
            some = words.counts()[words.owner()[first]] == n
            h, first = h[some], first[some]
        parts.append((mix(h ^ np.uint64(n)), first))
    h, first = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = words.owner()[first] if len(first) else first
    return words, h, owner, first - words.first[owner]


def tile(doc_at: np.ndarray, item_at: np.ndarray, least: int = SEED, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc word, item word, length) from all pairs of equal seeds; longest first, ties by place."""
    pairs = np.unique(np.stack([doc_at - item_at, doc_at], 1), axis=0)
    new = np.r_[True, (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] != pairs[:-1, 1] + 1)]
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(pairs)]) + seed - 1
    return tile_matches(pairs[start, 1], pairs[start, 1] - pairs[start, 0], length, least)


def tile_matches(d: np.ndarray, q: np.ndarray, n: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles from the longest matches (doc word, item word, length); it ends when fewer words of the item than a tile has are left to cover."""
    some = n >= least
    d, q, n = d[some], q[some], n[some]
    if not len(d):
        return []
    from_d = int(d.min())
    in_doc, in_item, left = np.zeros(int((d + n).max()) - from_d, bool), np.zeros(int((q + n).max()), bool), covered_words(q, n)
    heap = list(zip((-n).tolist(), (d - from_d).tolist(), q.tolist(), strict=True))
    heapq.heapify(heap)
    out = []
    while heap and left >= least:
        size, at, to = heapq.heappop(heap)
        size = -size
        taken = in_doc[at : at + size] | in_item[to : to + size]
        if not taken.any():
            in_doc[at : at + size] = in_item[to : to + size] = True
            out.append((at + from_d, to, size))
            left -= size
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True]))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what earlier tiles have left of this match
            if j - i >= least:
                heapq.heappush(heap, (i - j, at + i, to + i))
    return out


def covered_words(q: np.ndarray, n: np.ndarray) -> int:
    """How many words of the item lie in some match."""
    depth = np.zeros(int((q + n).max()) + 1, np.int64)
    np.add.at(depth, q, 1)
    np.add.at(depth, q + n, -1)
    return int((np.cumsum(depth) > 0).sum())


def _paired(starts: tuple[np.ndarray, ...], ends: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Matches (row, item, doc word, item word, seeds in a row) from the pairs (row, item, doc word, item word) at which they begin and end."""
    order = lambda e: [x[np.lexsort((e[2], e[2] - e[3], e[1], e[0]))] for x in e]
    # along a diagonal beginnings and ends alternate
    (row, item, d, q), last = order(starts), order(ends)[2]
    return row, item, d, q, last - d + 1


def index(bench: DataFrame, most: int = MOST_SEEDS, seed: int = SEED) -> Index | None:
    """All seeds of bench(item_id, text) as sorted arrays; None if there are more than ``most``."""
    rows = _seed_rows(bench, "item_id", seed, tuple(range(1, seed)), True, 1)
    held = rows.limit(most + 1).toArrow()
    if held.num_rows > most:
        return None
    keys = list(zip(held.column("id").to_pylist(), held.column("n").to_pylist(), held.column("text_hash").to_pylist(), strict=True))
    known = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    item = np.array([known[k] for k in keys], np.int64)
    lengths = np.array([k[1] for k in known], np.int64)
    h, place, before, after = (held.column(c).to_numpy() for c in ("seed", "place", "before", "after"))
    h, before, after = (x.view(np.uint64) for x in (h, before, after))
    long = lengths[item] >= seed if len(item) else np.zeros(0, bool)
    order = np.argsort(h[~long], kind="stable")
    sides = [edges(h[long], item[long], place[long], x[long]) for x in (before, after)]
    return Index(*sides, h[~long][order], item[~long][order], [k[0] for k in known], lengths)


def _seed_rows(df: DataFrame, name: str, seed: int, short: tuple[int, ...], whole: bool = False, side: int = 0) -> DataFrame:
    """(id, text_hash, n, seed, place, before, after): one row for each seed of each distinct row; ``side`` is 0 for documents, 1 for items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, h, owner, place = seeds(part.column("text"), seed, short, whole)
                at, sides = pa.array(owner), beside(words, owner, place, seed, _NO_WORD[side])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("text_hash").take(at), pa.array(words.counts()[owner]), pa.array(h.view(np.int64)), pa.array(place), *[pa.array(x.view(np.int64)) for x in sides]],
                    ["id", "text_hash", "n", "seed", "place", "before", "after"],
                )

    df = ensure(df, name, "text")
    kind = df.schema[name].dataType.simpleString()
    rows = df.select(F.col(name).alias("id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"id {kind}, text_hash long, n long, seed long, place long, before long, after long").distinct()


def _matches(found: Index, texts: pa.Array, seed: int, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(row, item, tiles) for texts that cover enough of an item."""
    words, h, owner, place = seeds(texts, seed, tuple(np.unique(found.lengths[found.lengths < seed]).tolist()))
    if not len(h):
        return
    some = np.flatnonzero(_sieved(found, h))
    h, owner, place = h[some], owner[some], place[some]
    parts = []
    for side, near in zip((found.starts, found.ends), beside(words, owner, place, seed, _NO_WORD[0]), strict=True):
        own, at = _unlike(side, h, near)
        parts.append((owner[own], side.item[at], place[own], side.place[at]))
    row, item, d, q, n = _paired(*parts)
    n += seed - 1
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]), True]) if len(row) else []
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        wanted = coverage * found.lengths[item[s]]
        if covered_words(q[s:e], n[s:e]) >= wanted:
            tiles = tile_matches(d[s:e], q[s:e], n[s:e], seed)
            if sum(t[2] for t in tiles) >= wanted:
                yield int(row[s]), int(item[s]), tiles
    if len(found.whole):  # items of fewer words than a seed, at their first place
        at = np.searchsorted(found.whole, h)
        hit = np.flatnonzero((at < len(found.whole)) & (found.whole[np.minimum(at, len(found.whole) - 1)] == h))
        hit = hit[np.lexsort((place[hit], h[hit], owner[hit]))]
        hit = hit[np.r_[True, (owner[hit][1:] != owner[hit][:-1]) | (h[hit][1:] != h[hit][:-1])]] if len(hit) else hit
        for i in hit.tolist():
            for k in range(int(np.searchsorted(found.whole, h[i], "left")), int(np.searchsorted(found.whole, h[i], "right"))):
                yield int(owner[i]), int(found.whole_item[k]), [(int(place[i]), 0, int(found.lengths[found.whole_item[k]]))]


def _sieved(found: Index, h: np.ndarray) -> np.ndarray:
    """Whether a hash may be one of the items': most of a document's seeds are told apart by 20 bits."""
    low = lambda x: (x & np.uint64((1 << 20) - 1)).astype(np.int64)
    sieve = np.zeros(1 << 20, bool)
    sieve[low(found.starts.seeds)] = sieve[low(found.whole)] = True
    return sieve[low(h)]


def overlaps(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE, seed: int = SEED, most: int = MOST_SEEDS) -> DataFrame:
    """doc_id, item_id, item_words, covered, coverage, contaminated (true), tiles: documents against items they cover enough.

    Null texts are empty.  Items of fewer than ``seed`` words are matched as a
    whole, items without words never.  Repeated rows of docs repeat their pairs; rows of bench
    that repeat count once.  Extra columns are ignored.
    """
    docs = ensure(docs, "doc_id", "text")
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    found = index(bench, most, seed)
    if found is None:
        pairs = _same_row(docs, _overlaps_by_join(docs, bench, coverage, seed), "inner")
    else:
        sent = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sent.value
            ids = pa.array(found.ids)
            for batch in batches:
                for part in text_slices(batch, "text"):
                    got = list(_matches(found, part.column("text"), seed, coverage))
                    row, item = pa.array([g[0] for g in got], pa.int64()), [g[1] for g in got]
                    yield _rows(part.column("doc_id").take(row), ids.take(pa.array(item, pa.int64())), found.lengths[item], [g[2] for g in got])

        pairs = docs.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, item_words long, covered long, tiles {_TILE}")
    share = F.col("covered") / F.col("item_words")
    return pairs.select("doc_id", "item_id", "item_words", "covered", share.alias("coverage"), F.lit(True).alias("contaminated"), "tiles")


def _rows(doc_ids: pa.Array, item_ids: pa.Array, lengths, tiles: list) -> pa.RecordBatch:
    spans = pa.array([[{"doc_start": d, "item_start": q, "length": n} for d, q, n in sorted(t)] for t in tiles], pa.list_(pa.struct([("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())])))
    covered = pa.array([sum(x[2] for x in t) for t in tiles], pa.int64())
    return pa.RecordBatch.from_arrays([doc_ids, item_ids, pa.array(lengths, pa.int64()), covered, spans], ["doc_id", "item_id", "item_words", "covered", "tiles"])


def _overlaps_by_join(docs: DataFrame, bench: DataFrame, coverage: float, seed: int) -> DataFrame:
    """The same pairs with doc_hash, once for each doc_id and text, where the benchmark isn't small: seeds meet by a shuffled join, pairs are tiled by document and item."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    held = _seed_rows(bench, "item_id", seed, tuple(range(1, seed)), True, 1)
    short = tuple(sorted(r.n for r in held.filter(F.col("n") < seed).select("n").distinct().collect()))  # fewer than a seed's words
    left = _seed_rows(docs, "doc_id", seed, short).select(F.col("id").alias("doc_id"), F.col("text_hash").alias("doc_hash"), "seed", F.col("place").alias("doc_at"), "before", "after")
    right = held.select(F.col("id").alias("item_id"), F.col("text_hash").alias("item_hash"), "n", "seed", F.col("place").alias("item_at"), F.col("before").alias("item_before"), F.col("after").alias("item_after"))

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        d, q, begins, ends = (table.column(c).to_numpy() for c in ("doc_at", "item_at", "begins", "ends"))
        if n < seed:
            tiles = [(int(d.min()), 0, n)]
        else:
            none = np.zeros(len(d), np.int64)
            _, _, d, q, size = _paired(*[(none[x], none[x], d[x], q[x]) for x in (begins, ends)])
            tiles = tile_matches(d, q, size + seed - 1, seed)
        keep = [tiles] if sum(t[2] for t in tiles) >= coverage * n else []
        one = lambda c: table.column(c).combine_chunks().slice(0, len(keep))
        return pa.Table.from_batches([_rows(one("doc_id"), one("item_id"), [n] * len(keep), keep).append_column("doc_hash", one("doc_hash"))])

    # a seed may stand in most documents; of its places only those where a match begins or ends leave the join
    joined = join_hot(left, right, "seed", 8).withColumns({"begins": F.expr("before <> item_before"), "ends": F.expr("after <> item_after")}).filter(F.col("begins") | F.col("ends") | (F.col("n") < seed))
    return joined.groupBy("doc_id", "doc_hash", "item_id", "item_hash").applyInArrow(run, f"doc_id {kind}, item_id {item_kind}, item_words long, covered long, tiles {_TILE}, doc_hash long")


def _same_row(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs joined with found(doc_id, doc_hash, ...) on id and text, since the id alone may be null or repeated."""
    found = found.withColumnsRenamed({"doc_id": "_found_id", "doc_hash": "_found_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_found_id")) & (F.xxhash64("text") == F.col("_found_hash"))
    return docs.hint("merge").join(found.hint("merge"), same, how)


def drop_contaminated(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE, seed: int = SEED, most: int = MOST_SEEDS) -> DataFrame:
    """docs without contaminated rows, all columns kept."""
    docs, restored = by_position(docs, "doc_id", "text")
    found = index(bench, most, seed)
    if found is None:
        bad = _overlaps_by_join(docs, bench, coverage, seed).select("doc_id", "doc_hash").distinct()
        return restored(_same_row(docs, bad, "left_anti"))
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, _, _ in _matches(sent.value, part.column("text"), seed, coverage)]] = False
                yield part.filter(pa.array(keep))

    return restored(docs.mapInArrow(run, docs.schema))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
