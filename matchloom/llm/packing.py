"""Packing documents into sequences of a fixed number of tokens by a grouping genetic algorithm on islands.

Documents become pieces of at most a sequence's tokens; only longer documents are
cut.  Open pieces are dealt at random into blocks of a bounded number.  For each
block several islands evolve packings of their own: a crossover injects whole
well-filled bins of one parent into the other, bins that hold one of their pieces
again are dissolved, displaced pieces replace shorter ones where that fills a bin,
and the rest go, longest first, where they fit best.
Between epochs the elite of each island moves to the next one.  The emptiest bins
of all blocks are released and dealt anew, until one block holds what is left, so
cutting the work into blocks costs next to nothing.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _sent, _vocabulary
from .stage import cut, ensure
from .textkit import text_slices

CAPACITY = 2048
#: Token that ends a document.
END = 0
#: Pieces a block holds on average; a block is what one task has in memory.
BLOCK = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 24
#: Bins that a crossover injects, and worst-filled ones that it dissolves besides.
INJECTED, DISSOLVED = 6, 2
#: Share of a block's pieces in the bins that it releases for another round.
RELEASED = 0.25


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 and, on demand, ids (little-endian unsigned 32-bit) of every document.

    A document is its tokens, then ``end``; null and empty texts have that token
    alone.  Longer ones than ``capacity`` are cut there.  Rows stand for
    themselves, repeated ones too; ids may be null and of any type; extra columns
    are dropped.
    """
    docs, sent = ensure(docs, "doc_id", "text"), _sent(docs, tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                whole = [x + last for x in vocabulary.encode_all([t or "" for t in part.column("text").to_pylist()])]
                parts = [(i, n, x[at : at + 4 * capacity]) for i, x in enumerate(whole) for n, at in enumerate(range(0, len(x), 4 * capacity))]
                own, number = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
                made = [part.column("doc_id").take(pa.array(own)), pa.array(number), pa.array(number * capacity), pa.array([len(p[2]) // 4 for p in parts], pa.int64()), pa.array([zlib.crc32(p[2]) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*made, *[pa.array([p[2] for p in parts], pa.binary())] * ids], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    return docs.mapInArrow(run, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def least_bins(size: np.ndarray, capacity: int) -> int:
    """A proven lower bound of the bins needed (Martello and Toth's L2)."""
    many = np.bincount(size, minlength=capacity + 1)
    upto, held = np.cumsum(many), np.cumsum(many * np.arange(capacity + 1))
    small = np.arange(capacity // 2 + 1)  # the least size counted among the small ones
    big = upto[capacity] - upto[capacity - small]
    middle, middle_held = upto[capacity - small] - upto[capacity // 2], held[capacity - small] - held[capacity // 2]
    little = held[capacity // 2] - np.where(small > 0, held[small - 1], 0)
    need = big + middle + np.maximum(0, -((middle * capacity - middle_held - little) // capacity))
    return int(need.max())


def best_fit(items: list[int], size: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Puts each item where it leaves least room, in the order given; opens a bin where none has room."""
    with_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b, room in enumerate(free):
        with_free[room].append(b)
    mask = sum(1 << room for room in set(free))
    for i in items:
        n = size[i]
        if above := mask >> n:
            room = n + (above & -above).bit_length() - 1
            b = with_free[room].pop()
            if not with_free[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            free.append(capacity)
        free[b] = room - n
        with_free[room - n].append(b)
        mask |= 1 << (room - n)


class Packing:
    """One individual: its bins, the room left in each, and its fitness (fewer bins, then fuller ones)."""

    __slots__ = ("bins", "free", "fitness")

    def __init__(self, bins: list[list[int]], free: list[int], capacity: int):
        self.bins, self.free = bins, free
        self.fitness = (len(bins), -sum((capacity - r) ** 2 for r in free))

    def owners(self, n: int) -> np.ndarray:
        out = np.empty(n, np.uint16)
        for b, own in enumerate(self.bins):
            out[own] = b
        return out


def _read(owners: bytes, size: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = []
    for i, b in enumerate(np.frombuffer(owners, np.uint16).tolist()):
        while b >= len(bins):
            bins.append([])
        bins[b].append(i)
    return Packing(bins, [capacity - sum(map(size.__getitem__, own)) for own in bins], capacity)


def exchange(displaced: list[int], size: list[int], bins: list[list[int]], free: list[int]) -> None:
    """Swaps items of bins with room for the longest displaced ones that fit in their stead; ``displaced`` stays sorted by size."""
    sizes = [size[i] for i in displaced]
    for b, own in enumerate(bins):
        for k in range(len(own)):
            if not free[b]:
                break
            i, n = own[k], size[own[k]]
            at = bisect_right(sizes, n + free[b]) - 1
            if at >= 0 and sizes[at] > n:
                own[k], free[b] = displaced.pop(at), free[b] - sizes.pop(at) + n
                back = bisect_right(sizes, n)
                displaced.insert(back, i)
                sizes.insert(back, n)


def crossover(a: Packing, b: Packing, size: list[int], capacity: int, rnd: random.Random) -> Packing:
    """a with some well-filled bins of b: bins of a that hold their items dissolve, and what is displaced is fitted best."""
    by_room = sorted(range(len(b.bins)), key=b.free.__getitem__)
    chosen = rnd.sample(by_room[: max(1, len(by_room) // 2)], min(INJECTED, max(1, len(by_room) // 2)))
    taken = {i for c in chosen for i in b.bins[c]}
    worst = set(sorted(range(len(a.bins)), key=lambda x: -a.free[x])[:DISSOLVED])
    bins, free, displaced = [b.bins[c][:] for c in chosen], [b.free[c] for c in chosen], []
    for k, own in enumerate(a.bins):
        if k in worst or not taken.isdisjoint(own):
            displaced += [i for i in own if i not in taken]
        else:
            bins.append(own[:])
            free.append(a.free[k])
    displaced.sort(key=size.__getitem__)
    exchange(displaced, size, bins, free)
    best_fit(displaced[::-1], size, bins, free, capacity)
    return Packing(bins, free, capacity)


def evolve(size: list[int], population: list[Packing], guests: list[Packing], capacity: int, rnd: random.Random, generations: int) -> list[Packing]:
    """The population after an epoch, best first; it begins with best fit decreasing and ends early at the proven bound."""
    least = least_bins(np.array(size, np.int64), capacity)
    population = sorted([*population, *guests], key=lambda p: p.fitness)[:POPULATION]
    while len(population) < POPULATION and (not population or population[0].fitness[0] > least):
        noise = 0.2 * bool(population)  # the first is best fit decreasing itself
        order = sorted(range(len(size)), key=lambda i: -size[i] * (1 + noise * rnd.random()))
        bins, free = [], []
        best_fit(order, size, bins, free, capacity)
        population.append(Packing(bins, free, capacity))
        population.sort(key=lambda p: p.fitness)
    for _ in range(generations):
        if population[0].fitness[0] <= least or len(population) < 2:
            break
        a, b = sorted(rnd.sample(range(len(population)), 2))
        child = crossover(population[a], population[b], size, capacity, rnd)
        if child.fitness < population[-1].fitness and all(child.fitness != p.fitness for p in population):
            population[-1] = child
            population.sort(key=lambda p: p.fitness)
    return population


def _epoch(islands: DataFrame, capacity: int, generations: int) -> DataFrame:
    """(_block, _island, _sizes, _population, _guests) after some generations; _bins is the best individual's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                size, rnd = r["_sizes"], random.Random(f"{r['_block']}/{r['_island']}/{len(r['_sizes'])}/{len(r['_guests'])}")
                held = [[_read(x, size, capacity) for x in r[c]] for c in ("_population", "_guests")]
                best = evolve(size, *held, capacity, rnd, generations)
                rows.append({**r, "_population": [p.owners(len(size)).tobytes() for p in best], "_guests": [], "_bins": best[0].fitness[0], "_fill": best[0].fitness[1]})
            yield pa.RecordBatch.from_pylist(rows, schema=_STATE)

    return islands.mapInArrow(run, "_block long, _island int, _sizes array<int>, _population array<binary>, _guests array<binary>, _bins long, _fill long")


_STATE = pa.schema([("_block", pa.int64()), ("_island", pa.int32()), ("_sizes", pa.list_(pa.int32())), ("_population", pa.list_(pa.binary())), ("_guests", pa.list_(pa.binary())), ("_bins", pa.int64()), ("_fill", pa.int64())])


def _placed(best: DataFrame, capacity: int, last: bool) -> DataFrame:
    """For each block arrays in the order of its items: the first item of an item's bin, its place there, and whether the bin is released."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                size, owner = np.array(r["_sizes"], np.int64), np.frombuffer(r["_owners"], np.uint16).astype(np.int64)
                order = np.argsort(owner, kind="stable")
                begin = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
                many = np.diff(np.r_[begin, len(order)])
                before = np.cumsum(size[order]) - size[order]
                first, place = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
                first[order], place[order] = np.repeat(order[begin], many), before - np.repeat(before[begin], many)
                fill = np.bincount(owner, size).astype(np.int64)
                emptiest = np.argsort(fill, kind="stable")
                emptiest = emptiest[(np.cumsum(many[emptiest]) <= RELEASED * len(size)) & (fill[emptiest] < capacity)] if not last else emptiest[:0]
                rows.append({"_block": r["_block"], "_placed": [{"first": a, "place": b, "released": c} for a, b, c in zip(first.tolist(), place.tolist(), np.isin(owner, emptiest).tolist(), strict=True)]})
            yield pa.RecordBatch.from_pylist(rows, schema=_PLACED)

    return best.mapInArrow(run, "_block long, _placed array<struct<first:int,place:long,released:boolean>>")


_PLACED = pa.schema([("_block", pa.int64()), ("_placed", pa.list_(pa.struct([("first", pa.int32()), ("place", pa.int64()), ("released", pa.bool_())])))])


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """items(length, ...) with sequence_id and offset: as few sequences as it can of at most ``capacity``, gapless from offset 0.

    An item longer than a sequence, or without a length, ends the job with an
    error.  Equal rows are items of their own.  A block, of ``block`` items on
    average and a few standard deviations more at most, is one row of its table.
    """
    if block > 32_000:
        raise ValueError("a block holds 32,000 items at most")
    wrong = F.raise_error(F.lit(f"items need a length from 0 to {capacity}")).cast("long")
    items = items.withColumn("length", F.when(F.col("length").between(0, capacity), F.col("length").cast("long")).otherwise(wrong))
    names = items.columns
    items = cut(items).withColumn("_key", F.monotonically_increasing_id())  # the checkpoint fixes the order
    done = [items.filter(F.col("length") >= capacity).select(*names, F.col("_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, rounds = items.filter(F.col("length") < capacity), 0
    while many := left.count():
        blocks = math.ceil(many / block)
        placed = cut(_solve(left, names, blocks, rounds, capacity, islands, epochs, generations))
        done.append(placed.filter("not _released").select(*names, "sequence_id", "offset"))
        left, rounds = placed.filter("_released").select(*names, "_key"), rounds + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _solve(left: DataFrame, names: list[str], blocks: int, rounds: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    dealt = left.withColumn("_block", F.pmod(F.xxhash64("_key", F.lit(rounds)), F.lit(blocks)))
    # sorted by the unique key, so that a recomputed block has the same order
    held = cut(dealt.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_key", *names))).alias("_items")))
    sizes = F.transform("_items", lambda x: x["length"].cast("int"))
    none = F.array().cast("array<binary>")
    state = held.select("_block", F.explode(F.array(*map(F.lit, range(islands)))).alias("_island"), sizes.alias("_sizes"), none.alias("_population"), none.alias("_guests"))
    state = state.repartition(min(2 * blocks * islands, 4096), "_block", "_island")
    for epoch in range(epochs):
        state = cut(_epoch(state, capacity, generations))
        if epoch + 1 < epochs:
            moved = state.select("_block", F.pmod(F.col("_island") + 1, F.lit(islands)).alias("_island"), F.slice("_population", 1, 1).alias("_guests"))
            state = state.drop("_guests", "_bins", "_fill").hint("merge").join(moved.hint("merge"), ["_block", "_island"]).select("_block", "_island", "_sizes", "_population", "_guests")
    best = state.groupBy("_block").agg(F.min_by(F.struct("_sizes", F.element_at("_population", 1).alias("_owners")), F.struct("_bins", "_fill", "_island")).alias("x")).select("_block", "x.*")
    placed = _placed(best, capacity, blocks == 1)
    both = held.hint("merge").join(placed.hint("merge"), "_block")
    first = F.transform("_placed", lambda p: F.element_at("_items", p["first"] + 1)["_key"])
    rows = both.select(F.explode(F.arrays_zip("_items", "_placed", first.alias("_first"))).alias("x"))
    return rows.select("x._items.*", F.col("x._first").alias("sequence_id"), F.col("x._placed.place").alias("offset"), F.col("x._placed.released").alias("_released"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids, the tokens of its pieces in their order, of packed pieces with ids; null ids stand for none."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.coalesce("ids", F.lit(b"")).alias("ids")))).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return own.select("sequence_id", joined.alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
