"""Near copies for the pipeline: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two indexes.  Texts whose SimHash fingerprints over
five-word shingles differ in four bits at most meet in the deletion-variant
index, exactly and however many share a key.  A 64-bit SimHash can't tell a
similarity of 0.8, though: such texts differ in about ten bits, some in twenty,
and no few segments cover that.  So others meet in MinHash bands: 20 keys of 5
minima each, of which a pair at 0.8 shares one with a probability of 0.9996.

Small bands pair all members whose sketches are alike, and the pairs are compared
by their whole shingle sets.  A larger band is worked on in one task: each member
is compared with those before it that its sketch is like, the likeliest first, but
for those that links have joined with it already, so a family of copies yields a
link a member.  The task holds the texts of the latest members within a bound, and
the sketches of all; a likely pair with a member whose text has gone is compared
elsewhere.  Bands of more members than MOST go to tasks by pairs of blocks, so any
two members of a band meet, however many it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import simhash
from .components import components, join_hot, one_of_each
from .stage import by_position, cut, ensure
from .substring_dedup import _key
from .textkit import Words, mix, text_slices

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
#: Similarity told by sketches from which a pair is compared, four deviations below 0.8.
LIKELY = 0.6
#: Members of a band that are paired outside it, and members whose texts a task holds at most.
SMALL, MOST = 16, 16_384
#: Bytes of compressed texts that a task holds at most.
MOST_BYTES = 256 << 20
#: Members of a block at most, about 50 bytes each; half of ``most`` counts if it is less.
BLOCK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = mix(np.arange(BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the text of each, in text order; a shorter text is one shingle."""
    parts = []
    for n in range(1, SHINGLE + 1):
        h, first = words.windows(hashes, n)
        owner = words.owner()[first] if len(first) else first
        some = slice(None) if n == SHINGLE else words.counts()[owner] == n
        parts.append((h[some], owner[some]))
    h, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(owner, kind="stable")
    return h[order], owner[order]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            words = Words(part.column("text"), _LOWER)
            hashes = words.hashes()
            key = _key(part.column("text"), words, hashes)
            h, owner = shingles(words, hashes)
            if not len(h):
                continue
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = mix(np.stack([np.minimum.reduceat(h * f, start) for f in _FACTORS], 1))
            band = np.zeros((len(start), BANDS), np.uint64)
            for r in range(ROWS):
                band = mix(band ^ low[:, r::ROWS])
            sketch = np.packbits(np.unpackbits((low & np.uint64(3)).astype(np.uint8)[:, :, None], axis=2)[:, :, 6:].reshape(len(start), -1), axis=1)
            sketch = np.pad(sketch, ((0, 0), (0, -sketch.shape[1] % 8)))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32)), pa.array(band.reshape(-1).view(np.int64)))
            raw, own = words.raw.tobytes(), owner[start]
            fp = np.array([simhash.fingerprint(raw[s:e], SHINGLE) for s, e in zip(words.off[own].tolist(), words.off[own + 1].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(fp.view(np.int64)), bands, pa.array([x.tobytes() for x in sketch], pa.binary())], ["key", "fp", "bands", "sketch"])


_ODD = np.uint64(0x5555555555555555)


def told(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of texts as their sketches tell it: two bits of each minimum agree by chance in a quarter of cases."""
    differ = x ^ y
    differ = np.bitwise_count((differ | (differ >> np.uint64(1))) & _ODD).sum(-1, dtype=np.int64)
    return (1 - differ / (BANDS * ROWS) - 0.25) / 0.75


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (band, key, sketch) sorted by band: pairs of bands of SMALL members at most whose sketches are alike."""
    band, key, sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    passed = None  # a large band that goes on

    def pairs(band, key, sketch) -> pa.RecordBatch:
        size = np.diff(np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])) if len(band) else np.zeros(0, np.int64)
        few = np.repeat((size > 1) & (size <= SMALL), size)
        band, key, sketch = band[few], key[few], sketch[few]
        out = [np.zeros((0, 2), np.int64)]
        for d in range(1, min(SMALL, len(band))):
            same = np.flatnonzero(band[d:] == band[:-d]) + d
            same = same[told(sketch[same - d], sketch[same]) >= LIKELY]
            out.append(np.stack([key[same - d], key[same]], 1))
        out = np.unique(np.sort(np.concatenate(out), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        more = _sketches(batch)
        band, key = np.concatenate([band, batch.column("band").to_numpy()]), np.concatenate([key, batch.column("key").to_numpy()])
        sketch = more if sketch is None else np.concatenate([sketch, more])
        if passed is not None:
            n = int(np.searchsorted(band != passed, True))
            band, key, sketch = band[n:], key[n:], sketch[n:]
            if not len(band):
                continue
            passed = None
        last = int(np.flatnonzero(np.r_[True, band[1:] != band[:-1]])[-1])  # the last band may go on in the next batch
        yield pairs(band[:last], key[:last], sketch[:last])
        band, key, sketch = band[last:], key[last:], sketch[last:]
        if len(band) > SMALL:
            passed, band, key, sketch = int(band[0]), band[:0], key[:0], sketch[:0]
    if len(band):
        yield pairs(band, key, sketch)


class _Band:
    """The members of one large band so far: the latest with their texts, the others with their sketches alone, each in a group of joined members."""

    def __init__(self, whole, most: int, most_bytes: int):
        self.whole, self.most, self.most_bytes, self.bytes, self.groups, self.start = whole, most, most_bytes, 0, 0, 0
        self.key, self.packed, self.group, self.sketch = [], [], np.zeros(64, np.int64), None
        self.past: dict[int, list[tuple[int, np.ndarray]]] = {}  # of each group the members whose texts have gone

    def links(self, key: int, sketch: np.ndarray, packed: bytes) -> list[tuple[int, int, bool]]:
        """Links of a new member, one to each group that has a similar one, which become one group, and pairs still to be compared.

        The latter are with likely members whose texts have gone, unless their group is joined anyway.
        """
        if self.sketch is None:
            self.sketch = np.zeros((64, len(sketch)), np.uint64)
        out, own = [], set()
        like = told(self.sketch[self.start : len(self.key)], sketch)
        rest = np.flatnonzero(like >= LIKELY)
        rest = rest[np.argsort(-like[rest], kind="stable")] + self.start
        while len(rest):
            i = int(rest[0])
            if similar(self.whole(key, packed), self.whole(self.key[i], self.packed[i])):
                own.add(int(self.group[i]))
                out.append((self.key[i], key, True))
                rest = rest[self.group[rest] != self.group[i]]
            else:
                rest = rest[1:]
        for g, members in self.past.items():
            if g not in own:
                out += [(members[i][0], key, False) for i in np.flatnonzero(told(np.stack([x for _, x in members]), sketch) >= LIKELY).tolist()]
        while self.start < len(self.key) and (len(self.key) - self.start >= self.most or self.bytes + len(packed) > self.most_bytes):
            self._let_go()
        self._add(key, sketch, packed)
        if own:
            held = self.group[self.start : len(self.key)]
            held[np.isin(held, list(own))] = self.groups
            parts = sorted((self.past.pop(g) for g in own if g in self.past), key=len)
            if parts:
                for p in parts[:-1]:
                    parts[-1].extend(p)
                self.past[self.groups] = parts[-1]
        return out

    def _let_go(self) -> None:
        i = self.start
        self.past.setdefault(int(self.group[i]), []).append((self.key[i], self.sketch[i].copy()))
        self.bytes -= len(self.packed[i])
        self.packed[i] = b""
        self.start += 1
        if self.start > 64 and 2 * self.start > len(self.key):
            n = len(self.key) - self.start
            self.sketch[:n], self.group[:n] = self.sketch[self.start : len(self.key)].copy(), self.group[self.start : len(self.key)].copy()
            self.key, self.packed, self.start = self.key[self.start :], self.packed[self.start :], 0

    def _add(self, key: int, sketch: np.ndarray, packed: bytes) -> None:
        n = len(self.key)
        if n == len(self.sketch):
            self.sketch, self.group = np.concatenate([self.sketch, np.zeros_like(self.sketch)]), np.concatenate([self.group, np.zeros_like(self.group)])
        self.key.append(key)
        self.packed.append(packed)
        self.bytes += len(packed)
        self.groups += 1
        self.sketch[n], self.group[n] = sketch, self.groups


def _linker(most: int = MOST, most_bytes: int = MOST_BYTES):
    """A function over rows (band, key, sketch, packed) sorted by band: links (a, b, known) that join the similar members of each band, not known ones if they prove similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, current, band = _expander(), None, None
        for batch in batches:
            out = []
            for b, k, x, p in zip(batch.column("band").to_pylist(), batch.column("key").to_pylist(), batch.column("sketch").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if b != current:
                    current, band = b, _Band(whole, most, most_bytes)
                out += band.links(k, np.frombuffer(x, np.uint64), p)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.bool_())], ["a", "b", "known"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in text_slices(batch, "text"):
            words = Words(part.column("text"), _LOWER)
            raw, off = words.raw.tobytes(), words.off.tolist()
            packed = [squeeze(raw[s:e]) for s, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_key(part.column("text"), words, words.hashes())), pa.array(packed, pa.binary())], ["key", "packed"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of SIMILAR or more."""
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def _expander(most: int = 4_000_000):
    """A function that gives the shingle set of a packed text; it remembers sets of ``most`` shingles at most."""
    expand, held, size = zstandard.ZstdDecompressor().decompress, {}, 0

    def whole(key: int, packed: bytes) -> np.ndarray:
        nonlocal size
        if key not in held:
            words = Words(pa.array([expand(packed)], pa.large_binary()))
            found = np.unique(shingles(words, words.hashes())[0])
            if size + len(found) > most:
                held.clear()
                size = 0
            held[key] = found
            size += len(found)
        return held[key]

    return whole


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = _expander()
    for batch in batches:
        keep = [similar(whole(a, x), whole(b, y)) for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b")), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _pairs_with(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    for c in ("a", "b"):
        pairs = pairs.hint("merge").join(rows.select(F.col("key").alias(c), F.col(value).alias(f"{value}_{c}")).hint("merge"), c)
    return pairs


def _near(signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of signed(key, fp) that span the texts which SimHash links."""
    low = cut(signed.groupBy("fp").agg(F.min("key").alias("low")))
    same = join_hot(signed.select("key", "fp"), low, "fp").filter("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    half = join_hot(simhash.links(low.select("fp")).select(F.col("a").alias("fp"), "b"), low, "fp").select(F.col("low").alias("a"), F.col("b").alias("fp"))
    unlike = join_hot(half, low, "fp").select("a", F.col("low").alias("b"))
    return cut(same.unionByName(unlike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))


def bands(signed: DataFrame, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of signed(key, bands, sketch) the likely pairs of small bands, and the rows (band, key, sketch) of large ones, those over ``most`` by pairs of blocks."""
    dealt = lambda rows: rows.repartition("band").sortWithinPartitions("band", "key")
    rows = signed.select("key", "sketch", "bands", F.posexplode("bands").alias("at", "value")).withColumn("band", F.xxhash64("at", "value"))
    pairs = dealt(rows.select("band", "key", "sketch")).mapInArrow(_meet, "a long, b long")
    crowd = cut(rows.groupBy("band").count().filter(F.col("count") > SMALL))
    large = rows.hint("merge").join(crowd.select("band").hint("merge"), "band", "left_semi").select("band", "key", "sketch")
    return pairs, _in_blocks(cut(large), most, block)


def _in_blocks(large: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """Rows (band, key, sketch), those of bands over ``most`` members in a band for each pair of their blocks, the block with itself included; two blocks hold about ``most``."""
    size = max(1, min(block, most // 2))
    blocks = cut(large.groupBy("band").count().filter(F.col("count") > min(most, block)).select("band", F.ceil(F.col("count") / size).cast("int").alias("n")))
    if blocks.isEmpty():
        return large
    own, other = F.pmod(F.xxhash64("key"), F.col("n")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    dealt = large.hint("merge").join(blocks.hint("merge"), "band").select("band", "key", "sketch", own, other)
    paired = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    return large.hint("merge").join(blocks.hint("merge"), "band", "left_anti").unionByName(dealt.select(paired.alias("band"), "key", "sketch"))


def links(docs: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of text keys with a Jaccard similarity of SIMILAR or more that join all such pairs that meet.

    The bounds ``most``, ``most_bytes`` and ``block`` are of a task's memory; links don't depend on them.
    """
    docs = ensure(docs, "text")
    signed = cut(docs.mapInArrow(_sign, "key long, fp long, bands array<long>, sketch binary").dropDuplicates(["key"]))
    pairs, large = bands(signed, most, block)
    likely, large = cut(pairs.unionByName(_near(signed)).distinct()), cut(large)
    wanted = likely.select(F.explode(F.array("a", "b")).alias("key")).unionByName(large.select("key")).distinct()
    texts = cut(docs.mapInArrow(_packed, "key long, packed binary").dropDuplicates(["key"]).hint("merge").join(wanted.hint("merge"), "key", "left_semi"))
    crowded = large.hint("merge").join(texts.hint("merge"), "key").repartition("band").sortWithinPartitions("band", "key")
    joined = cut(crowded.mapInArrow(_linker(most, most_bytes), "a long, b long, known boolean"))
    rest = joined.filter("not known").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    alike = _pairs_with(likely.unionByName(rest).distinct(), texts, "packed").mapInArrow(_verify, "a long, b long")
    return alike.unionByName(joined.filter("known").select("a", "b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: one row for each component of links, that of the smallest doc_id, all columns kept.

    Rows are told apart by all their columns, so rows of one doc_id with unlike
    texts both stay.  A null doc_id comes after all others.  Texts without words
    are copies of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = Words(part.column("text"), _LOWER)
                yield part.append_column("_key", pa.array(_key(part.column("text"), words, words.hashes())))

    docs, restored = by_position(docs, "doc_id", "text")
    rows = docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_key", LongType()))
    return restored(one_of_each(rows, components(links(docs))))
