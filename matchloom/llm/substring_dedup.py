"""Removal of repeated word passages by Karp-Rabin window hashes counted in Spark.

Every window of 13 words is hashed.  Within a slice of documents the windows that
an earlier document of the slice has too are decided at once, and each document
keeps one of equal windows, so that a window which very many documents share
leaves a slice once.  The others are packed into one row for each hash bucket,
in document order, so the shuffle carries little more than eight bytes a window.
A bucket finds, for each of its hashes, the smallest doc_id with that hash and
answers, for each document that holds such a window too, which of its windows in
that bucket go.  Documents meet their answers, windows turn into word intervals,
and touching intervals merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import ensure
from .textkit import SEGMENT, Words, mix, text_slices

WINDOW = 13
#: Windows a hash bucket holds on average, whatever the input; a bucket is what one task has in memory.
BUCKET_WINDOWS = 1 << 22
_NULL_ID = np.iinfo(np.int64).max


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _key(texts: pa.Array, words: Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each text, which tells apart rows that share a doc_id."""
    place = np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ mix(place.astype(np.uint64))))])
    return (total[words.first[1:]] - total[words.first[:-1]]).view(np.int64)


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").cast(pa.int64()).fill_null(_NULL_ID).to_numpy()


def _decided(h: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of a slice: whether an earlier document of the slice has it, and whether it is the first of its kind in its document."""
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    start = np.flatnonzero(new)
    own = ids[doc]
    low, decided, first = np.minimum.reduceat(own[order], start), np.empty(len(h), bool), np.empty(len(h), bool)
    decided[order] = np.repeat(low, np.diff(np.r_[start, len(order)])) < own[order]
    first[order] = new | np.r_[True, doc[order][1:] != doc[order][:-1]]
    return decided, first


_MESSAGES = ("bucket", "slice", "hashes", "ids", "keys", "sizes", "hits")


def _packer(window: int, buckets: int):
    """mapInArrow function: for each slice of documents the undecided hashes of each bucket, and what the slice has decided itself (hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                h, first = words.windows(hashes, window)
                if not len(h):
                    continue
                doc = np.repeat(np.arange(part.num_rows), words.counts())[first]
                ids, keys = _ids(part), _key(part.column("text"), words, hashes)
                tag = int(mix(keys.view(np.uint64) ^ mix(ids.view(np.uint64))).sum(dtype=np.uint64).view(np.int64))
                decided, once = _decided(h, doc, ids)
                rows = []
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                some = np.flatnonzero(np.bincount(doc[decided], minlength=part.num_rows))
                if len(some):
                    hits = b"".join([np.packbits(decided[edge[i] : edge[i + 1]]).tobytes() for i in some.tolist()])
                    rows.append((tag % buckets, tag, None, ids[some].tobytes(), keys[some].tobytes(), np.diff(edge)[some].astype(np.int32).tobytes(), hits))
                ask = np.flatnonzero(once & ~decided)
                b = _bucket(h[ask], buckets).astype(np.int32)
                order = np.argsort(b, kind="stable")
                b, own_h, own_doc = b[order], h[ask][order], doc[ask][order]
                edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else []
                for s, e in zip(edge[:-1], edge[1:], strict=True):
                    at = np.flatnonzero(np.r_[True, own_doc[s + 1 : e] != own_doc[s : e - 1], True])
                    own = own_doc[s:e][at[:-1]]
                    rows.append((int(b[s]), tag, own_h[s:e].tobytes(), ids[own].tobytes(), keys[own].tobytes(), np.diff(at).astype(np.int32).tobytes(), None))
                kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(_MESSAGES))

    return run


def _judge(groups: int):
    """applyInArrow function over one bucket: for each group of documents, which of their windows start in an earlier one."""

    def answers(bucket, rows, chosen) -> list[tuple]:
        """Rows for groups of documents; chosen tells which documents get an answer, and the bits of each."""
        ids, keys, sizes = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("ids", np.int64), ("keys", np.int64), ("sizes", np.int32)))
        tags = np.repeat(np.array([r["slice"] for r in rows], np.int64), [len(r["ids"]) // 8 for r in rows])
        some, bits = chosen(ids, sizes)
        group = _bucket(mix(keys[some].view(np.uint64) ^ mix(ids[some].view(np.uint64))), groups)  # copies of one text spread over groups
        some = some[np.argsort(group, kind="stable")]
        edge = np.searchsorted(np.sort(group), np.arange(groups + 1, dtype=np.uint64))
        out = []
        for g in np.flatnonzero(np.diff(edge)).tolist():
            own = some[edge[g] : edge[g + 1]]
            out.append((g, bucket, tags[own].tobytes(), ids[own].tobytes(), keys[own].tobytes(), sizes[own].tobytes(), b"".join([bits(i) for i in own.tolist()])))
        return out

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(list(_MESSAGES)).to_pylist()
        done, asked, out = [r for r in rows if r["hashes"] is None], [r for r in rows if r["hashes"] is not None], []
        if done:
            data = b"".join([r["hits"] for r in done])

            def all_of(ids, sizes):
                size = -(-sizes // 8)
                stop = np.cumsum(size)
                return np.arange(len(ids)), lambda i: data[stop[i] - size[i] : stop[i]]

            out += answers(-1, done, all_of)
        if asked:
            h = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in asked])

            def hit_ones(ids, sizes):
                doc = np.repeat(ids, sizes)
                order = np.argsort(h, kind="stable")
                start = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
                low = np.minimum.reduceat(doc[order], start)
                hit = np.empty(len(h), bool)
                hit[order] = np.repeat(low, np.diff(np.r_[start, len(order)])) < doc[order]
                stop = np.cumsum(sizes)
                return np.flatnonzero(np.add.reduceat(hit, stop - sizes) > 0), lambda i: np.packbits(hit[stop[i] - sizes[i] : stop[i]]).tobytes()

            out += answers(asked[0]["bucket"], asked, hit_ones)
        return pa.table(dict(zip(_ANSWERS.names, [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(_ANSWERS), _ANSWERS, strict=True)], strict=True)))

    return run


_ANSWERS = pa.schema([("group", pa.int32()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in ("slices", "ids", "keys", "sizes", "hits")]])


def _gather(table: pa.Table) -> pa.Table:
    """All answers to one group of documents: a row (id, key, answers) for each document with any.

    Rows that are repeated in several slices have the same windows to lose; the answers of one slice are kept.
    """
    found: dict[tuple[int, int], dict[int, dict[int, bytes]]] = {}
    for row in table.select(["bucket", "slices", "ids", "keys", "sizes", "hits"]).to_pylist():
        sizes, at = np.frombuffer(row["sizes"], np.int32), 0
        tags, ids, keys = (np.frombuffer(row[c], np.int64).tolist() for c in ("slices", "ids", "keys"))
        for t, i, k, n in zip(tags, ids, keys, (-(-sizes // 8)).tolist(), strict=True):
            found.setdefault((i, k), {}).setdefault(t, {})[row["bucket"]] = row["hits"][at : at + n]
            at += n
    answers = [[{"bucket": b, "hits": h} for b, h in x[min(x)].items()] for x in found.values()]
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("hits", pa.binary())]))
    return pa.table({"id": pa.array([i for i, _ in found], pa.int64()), "key": pa.array([k for _, k in found], pa.int64()), "answers": pa.array(answers, kind)})


def _lost(h: np.ndarray, answers: list[dict], buckets: int) -> np.ndarray:
    """For the windows of one document whether they start in an earlier one, from the answers to it."""
    hit = np.zeros(len(h), bool)
    for a in answers:
        if a["bucket"] < 0:
            hit = np.unpackbits(np.frombuffer(a["hits"], np.uint8), count=len(h)).astype(bool)
    rest = np.flatnonzero(~hit)
    _, first, kind = np.unique(h[rest], return_index=True, return_inverse=True)
    order = np.argsort(first)
    asked = rest[first[order]]
    b, told = _bucket(h[asked], buckets), np.zeros(len(asked), bool)
    for a in answers:
        if a["bucket"] >= 0:
            at = np.flatnonzero(b == a["bucket"])
            told[at] = np.unpackbits(np.frombuffer(a["hits"], np.uint8), count=len(at)).astype(bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hit[rest] = told[place[kind]]
    return hit


def repeated_windows(docs: DataFrame, window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> tuple[DataFrame, int]:
    """(id, key, answers) for each document with repeated windows, and the number of buckets, which follows the size of all texts.

    A bucket answers whole groups of documents, one row each, so the rows of an
    answer don't multiply with the buckets.
    """
    docs = ensure(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (6 * bucket_windows)))
    groups = max(1, -(-size // bucket_windows))
    packed = docs.mapInArrow(_packer(window, buckets), "bucket int, slice long, hashes binary, ids binary, keys binary, sizes binary, hits binary")
    # a partition for each bucket, so a task's share doesn't grow with the input
    judged = packed.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_judge(groups), "group int, bucket int, slices binary, ids binary, keys binary, sizes binary, hits binary")
    return judged.groupBy("group").applyInArrow(_gather, "id long, key long, answers array<struct<bucket:int,hits:binary>>"), buckets


def _cover(size: int, first: np.ndarray, window: int) -> np.ndarray:
    """Start and end words of the maximal intervals covered by windows that start at ``first`` (sorted)."""
    if not len(first):
        return np.zeros((0, 2), np.int64)
    new = np.r_[True, np.diff(first) > window]
    last = np.r_[new[1:], True]
    return np.stack([first[new], first[last] + window], 1)


def _cutter(window: int, buckets: int):
    """mapInArrow function over documents with their answers: removal intervals and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            for part in text_slices(batch, "text"):
                words = Words(part.column("text"))
                h, first = words.windows(words.hashes(), window)
                owner = words.owner()[first]
                edge = np.searchsorted(owner, np.arange(part.num_rows + 1))
                raw, out = words.raw.tobytes(), []
                answers = part.column("answers").to_pylist()
                for i in range(part.num_rows):
                    lo, hi = words.first[i], words.first[i + 1]
                    spans = np.zeros((0, 2), np.int64)
                    if answers[i]:
                        hit = _lost(h[edge[i] : edge[i + 1]], answers[i], buckets)
                        spans = _cover(hi - lo, np.flatnonzero(hit), window)
                    keep = np.ones(hi - lo, bool)
                    for s, e in spans.tolist():
                        keep[s:e] = False
                    text = raw[words.off[i] : words.off[i + 1]].split()
                    kept = [w for w, k in zip(text, keep.tolist(), strict=True) if k] if len(spans) else text
                    out.append((len(text), int((~keep).sum()), spans.tolist(), b" ".join(kept).decode()))
                cols = list(zip(*out, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, the text compressed for the shuffle, and the key of its answers."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in text_slices(batch, "text"):
            words = Words(part.column("text"))
            raw, off = words.raw, words.off.tolist()
            packed = [squeeze(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            key = _key(part.column("text"), words, words.hashes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary()), pa.array(_ids(part)), pa.array(key)], ["doc_id", "packed", "id", "key"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the text again, no more of it at once than a slice holds (or one document)."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in text_slices(batch, "packed", SEGMENT // 4):
            texts = pa.array([expand(x) for x in part.column("packed").to_pylist()], pa.binary()).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts, part.column("answers")], ["doc_id", "text", "answers"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, removed (word intervals, end exclusive), kept (text).

    A word goes if it lies in a window of ``window`` words that also starts in a
    document with a smaller doc_id.  The first document keeps its passage, even
    if it repeats it within itself.  Rows that share a doc_id don't remove each
    other's words.  Rows without doc_id come after all others and keep what only
    they share.  Null and empty texts have no words; extra columns are ignored.
    """
    docs = ensure(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    answers, buckets = repeated_windows(docs, window, bucket_windows)
    keyed = docs.mapInArrow(_keyed, f"doc_id {kind}, packed binary, id long, key long")
    both = keyed.hint("merge").join(answers.hint("merge"), ["id", "key"], "left").select("doc_id", "packed", "answers")
    return both.mapInArrow(_cutter(window, buckets), f"doc_id {kind}, n_words long, n_removed long, removed array<array<long>>, kept string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
