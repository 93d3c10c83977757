"""Sparse text features for the classifiers: hashed words and structure statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import cut, ensure
from .textkit import Words, text_slices

STATISTICS = (
    "log_words", "word_bytes", "upper", "digit", "symbol", "point", "newline", "non_ascii",
    "distinct", "repeated_windows", "same_as_before", "symbol_words", "upper_words", "line_words",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>{}[]=~^_\\/@+",
    "point": b"!?.,;:", "newline": b"\n", "non_ascii": bytes(range(128, 256)),
}
_MASKS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in _CLASSES.items()}


class Sparse(NamedTuple):
    """Rows of (word bucket, times): entries ``first[i]:first[i + 1]`` belong to row i."""

    first: np.ndarray
    ids: np.ndarray
    times: np.ndarray


def hashed_words(words: Words, hashes: np.ndarray, buckets: int) -> Sparse:
    """Distinct word buckets of each text with how often they occur."""
    key = words.owner().astype(np.uint64) * np.uint64(buckets) + hashes % np.uint64(buckets)
    key, times = np.unique(key, return_counts=True)
    first = np.searchsorted(key, np.arange(len(words.first), dtype=np.uint64) * np.uint64(buckets))
    return Sparse(first, (key % np.uint64(buckets)).astype(np.int32), times.astype(np.float32))


def repeats(words: Words, hashes: np.ndarray, n: int = 3) -> np.ndarray:
    """For each word whether it lies in an n-word window that is found twice or more in its text."""
    h, first = words.windows(hashes, n)
    out = np.zeros(len(hashes), bool)
    if len(h):
        h = h ^ (words.owner()[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        s = h[order]
        same = np.r_[False, s[1:] == s[:-1]]
        twice = same | np.r_[same[1:], False]
        for j in range(n):
            out[first[order[twice]] + j] = True
    return out


def statistics(words: Words, hashes: np.ndarray) -> np.ndarray:
    """(texts, len(STATISTICS)) floats; shares are of bytes or of words, empty texts give zeros."""
    n = words.counts()
    size = np.diff(words.off)

    def per_text(flag: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[edges[1:]] - total[edges[:-1]]

    def per_word(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return total[words.end] - total[words.start]

    by_bytes = {name: per_text(mask[words.raw], words.off) for name, mask in _MASKS.items()}
    owner = words.owner()
    order = np.lexsort((hashes, owner))
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if len(hashes) else np.zeros(0, bool)
    before = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])] if len(hashes) else np.zeros(0, bool)
    repeated = repeats(words, hashes)
    upper = per_word(_MASKS["upper"][words.raw])
    length = words.end - words.start
    some, chars = np.maximum(n, 1), np.maximum(size, 1)
    return np.stack([
        np.log1p(n), (size / some), *[by_bytes[c] / chars for c in _CLASSES],
        per_text(new, words.first) / some, per_text(repeated, words.first) / some, per_text(before, words.first) / some,
        per_text(per_word(_MASKS["symbol"][words.raw]) > 0, words.first) / some, per_text(2 * upper > length, words.first) / some,
        n / (by_bytes["newline"] + 1),
    ], 1).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Fold 0 of 5 by the CRC-32 of the id as text (null: empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Entries (word bucket, times) of a labelled sample at most: 80 MB on the driver.
MOST_SAMPLED = 10_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, metadata: tuple[str, ...], buckets: int, most: int, count=None, most_entries: int = MOST_SAMPLED) -> dict[str, list]:
    """Features of at most ``most`` labelled rows outside the held-out fold, gathered on the driver.

    The rows are those with the smallest hashes of doc_id, as many of them as hold
    ``most_entries`` entries together; these bounds limit what reaches the driver.  Labels that are null or not 0 or
    1 are ignored, of several labels of one id the smallest counts, and of several
    documents with one id the one with the lowest statistics.  ``count`` turns
    texts into sparse rows in place of the plain words; statistics are left out then.
    """
    known = ensure(labels, "doc_id", label).withColumnRenamed(label, "label").filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = ensure(docs, "doc_id", "text", *metadata).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                if count:
                    stats, sparse = np.zeros((part.num_rows, 0)), count(part.column("text"))
                else:
                    words = Words(part.column("text"))
                    hashes = words.hashes()
                    stats, sparse = statistics(words, hashes), hashed_words(words, hashes, buckets)
                stats = np.concatenate([stats, meta_columns(part, metadata)], 1).astype("<f4")
                spans = [slice(a, b) for a, b in zip(sparse.first[:-1], sparse.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), part.column("label"), pa.array([s.tobytes() for s in stats], pa.binary()),
                    pa.array([sparse.ids[c].astype("<i4").tobytes() for c in spans], pa.binary()), pa.array([sparse.times[c].astype("<f4").tobytes() for c in spans], pa.binary()),
                ], ["doc_id", "label", "stats", "ids", "times"])

    found = rows.mapInArrow(run, "doc_id long, label int, stats binary, ids binary, times binary")
    # one row an id before anything is gathered, however often the documents repeat it
    once = cut(found.groupBy("doc_id").agg(F.min(F.struct("stats", "ids", "times", "label")).alias("x")).select("doc_id", "x.*"))
    sizes = once.select(F.xxhash64("doc_id").alias("h"), "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n")).toPandas().sort_values(["h", "doc_id"])  # ``most`` rows
    last = int((sizes["n"].cumsum() <= most_entries).sum())
    if last < len(sizes):
        h, i = (int(sizes[c].iloc[last]) for c in ("h", "doc_id"))
        once = once.filter((F.xxhash64("doc_id") < h) | ((F.xxhash64("doc_id") == h) & (F.col("doc_id") < i)))
    out = {"label": [], "stats": [], "ids": [], "times": []}
    for x in sorted(once.toArrow().to_pylist(), key=lambda x: x["doc_id"]):
        out["label"].append(x["label"])
        for name, kind in (("stats", "<f4"), ("ids", "<i4"), ("times", "<f4")):
            out[name].append(np.frombuffer(x[name], kind))
    return out


def meta_columns(part: pa.RecordBatch, metadata: tuple[str, ...]) -> np.ndarray:
    """Numeric metadata as log1p of the absolute value, null as -1."""
    out = np.empty((part.num_rows, len(metadata)), np.float32)
    for i, name in enumerate(metadata):
        x = part.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(x), -1, np.log1p(np.abs(np.nan_to_num(x))))
    return out


def join_rows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row edges and all entries of ragged rows."""
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return first, np.concatenate(rows) if rows else np.zeros(0, np.int32)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive entries by row; empty rows give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
