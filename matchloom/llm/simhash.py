"""SimHash near-duplicates linked through deletion-variant signatures.

Fingerprints that differ in at most four bits agree, up to one bit, on at least
one of a few segments.  The 64 bits are cut into five blocks; the segments are
the block pairs (0,1), (2,3), (2,4), (3,4).  However four differing bits fall on
the blocks, one segment holds at most one of them: at least one block is free of
them, and no two blocks can spoil all four pairs (`covers` proves it by
enumeration).  Overlapping segments of 26 bits keep the number of chance
candidates low where three plain segments of 21 bits would not.

Each distinct fingerprint is indexed under every segment with each of its bits
in turn made a wildcard.  Equal index keys are joined by a shuffle, candidates
are verified, and only a spanning forest of each key's members leaves the task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .components import components, join_hot, one_of_each
from .stage import by_position, cut, ensure
from .textkit import text_slices

BLOCKS = (13, 13, 13, 13, 12)
SEGMENTS = ((0, 1), (2, 3), (2, 4), (3, 4))
SHINGLE = 4
DISTANCE = 4
SALTS = 16
#: Members of one key that are compared within the task; larger keys go by `_balls`.
CROWD = 4096

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def covers(blocks: Sequence[int], segments: Sequence[Sequence[int]], distance: int) -> bool:
    """True if any ``distance`` differing bits leave some segment with one of them at most."""
    for spread in itertools.product(range(distance + 1), repeat=len(blocks)):
        if sum(spread) <= distance and all(sum(spread[b] for b in s) > 1 for s in segments):
            return False
    return True


def masks(blocks: Sequence[int] = BLOCKS, segments: Sequence[Sequence[int]] = SEGMENTS) -> list[int]:
    """For each segment and each of its bits, the segment without that bit."""
    first = [sum(blocks[:i]) for i in range(len(blocks))]
    out = []
    for s in segments:
        bits = [first[b] + i for b in s for i in range(blocks[b])]
        whole = sum(1 << b for b in bits)
        out += [whole & ~(1 << b) for b in bits]
    return out


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased word shingles, repeats included; no words: zero."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    n = len(words) - shingle + 1
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], stop[: n - 1] + 1))
    digest = xxhash.xxh64_intdigest
    set_bits, step = np.zeros(64, np.int64), 1 << 14
    for at in range(0, n, step):
        pairs = zip(start[at : at + step].tolist(), stop[shingle - 1 :][at : at + step].tolist(), strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in pairs], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _of_texts(part: pa.RecordBatch, shingle: int) -> np.ndarray:
    texts = (t.as_buffer() for t in part.column("text").cast(pa.binary()))
    return np.array([fingerprint(t.to_pybytes() if t else b"", shingle) for t in texts], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each row of docs, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_of_texts(part, shingle))], ["doc_id", "fp"])

    docs = ensure(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, found breadth first."""
    rest, edges = fp, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                front += list(found)
                rest = rest[~near]
    return edges


def _linker(distance: int, crowd: int):
    """mapInArrow function over rows (key, fp) sorted by key: links as (a, b), members of crowded keys as (fp, null)."""

    def emit(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[start, len(keys)])
        two = start[size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        pairs = [np.stack([fps[near], fps[near + 1]], 1)]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if e := _forest(np.unique(fps[s : s + n]), distance):
                pairs.append(np.array(e, np.uint64))
        out = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
        yield out[:, 0], out[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(a, b=None):
            a = np.ascontiguousarray(a).view(np.int64)
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.ascontiguousarray(b).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])

        key, fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            more = batch.column("fp").to_numpy().view(np.uint64)
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, more])
            if crowded is not None:  # the rest of a crowded key that an earlier batch began
                n = int(np.searchsorted(key != crowded, True))
                if n:
                    yield row(fp[:n])
                key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            crowded = None
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last:
                yield from _runs(key[:last], fp[:last], row)
            key, fp = key[last:], fp[last:]
            if len(key) > crowd:
                yield row(fp)
                crowded, key, fp = key[0], key[:0], fp[:0]
        if len(key):
            yield from _runs(key, fp, row)

    def _runs(key, fp, row):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        big = np.repeat(size > crowd, size)
        if big.any():
            yield row(fp[big])
        single = np.repeat(size == 1, size)
        keep = ~(big | single)
        if keep.any():
            for a, b in emit(key[keep], fp[keep]):
                if len(a):
                    yield row(a, b)

    return run


def _balls(fps: DataFrame) -> DataFrame:
    """Links (a, b) among fps(a) at distance four or less, without comparing pairs.

    Two fingerprints differ in four bits at most if and only if some value is
    within two bits of both.  Every fingerprint lists the 2,081 values within two
    bits; all that list a value are linked to the smallest of them.
    """
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    near = fps.select("a", F.explode(F.array(*[F.lit(x) for x in signed])).alias("flip")).select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("z"))
    low = near.groupBy("z").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low < high").select("z", "low")
    return near.hint("merge").join(low.hint("merge"), "z").filter("low < a").select(F.col("low").alias("a"), F.col("a").alias("b")).distinct()


def links(fps: DataFrame, distance: int = DISTANCE, blocks: Sequence[int] = BLOCKS, segments: Sequence[Sequence[int]] = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fps(fp) within ``distance`` bits.

    ``fps`` holds distinct fingerprints.  Keys with more than ``crowd`` members
    are not compared pairwise; their members are linked by `_balls`.
    """
    if not covers(blocks, segments, distance):
        raise ValueError("these segments miss some pairs")
    if distance > 4:
        raise ValueError("crowded keys are linked exactly up to four bits")
    signed = [x - (1 << 64) if x >> 63 else x for x in masks(blocks, segments)]
    index = fps.select("fp", F.posexplode(F.array(*[F.lit(x) for x in signed])).alias("variant", "mask")).select(
        F.xxhash64("variant", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp"
    )
    found = cut(index.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(distance, crowd), "a long, b long").distinct())
    near = found.filter("b is not null")
    crowded = found.filter("b is null").select("a")
    return near if crowded.isEmpty() else near.unionByName(_balls(crowded))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id, n_links.

    ``component_id`` is the smallest doc_id reachable over links, ``n_links`` the
    number of rows with the very same fingerprint, itself included.  Null and
    wordless texts have fingerprint zero and are linked like any other.  Repeated
    rows each get a row.  A null doc_id never becomes a component_id unless the
    whole component has no other.  Columns besides doc_id and text are ignored.
    Equal fingerprints are aggregated under 16 salts of doc_id before they meet,
    so a fingerprint that a third of all rows share isn't dealt to one task.
    """
    rows = cut(fingerprints(docs, shingle)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    distinct = cut(salted.groupBy("fp").agg(F.min("low").alias("low"), F.sum("n").alias("n")))
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.hint("merge").join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = join_hot(rooted.select("root", "fp", "n"), named, "root").select("fp", "component_id", "n")
    dealt = salted.select("fp", "salt").hint("merge").join(labels.hint("merge"), "fp")
    return rows.hint("merge").join(dealt.hint("merge"), ["fp", "salt"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("n").alias("n_links")
    )


def keep_one(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest doc_id stays, all columns kept.

    Rows of one doc_id with unlike texts lie in components of their own.  A null
    doc_id comes after all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield part.append_column("_key", pa.array(_of_texts(part, shingle)))

    docs, restored = by_position(docs, "doc_id", "text")
    rows = docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_key", LongType()))
    distinct = cut(rows.select(F.col("_key").alias("fp")).distinct())
    return restored(one_of_each(rows, components(links(distinct, distance))))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
