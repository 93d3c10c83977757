"""Periodic runs of words within a text: frequency splitting, then a lag scan of what survives.

A run is a stretch of words with smallest period q, of max(6, 4q) words or more,
that neither neighbour extends.  Each of its words occurs in it four times at
least, so a word that occurs less often within a segment splits it; the parts are
counted again, until no segment changes.  What is left is scanned by lags: small
lags by comparing words q apart, larger ones by classes [q, 1.5q] of lags, where a
position counts if its window of twice the largest lag comes again, next, at a
distance within the class.  Such a window has the distance as its smallest period
(Fine and Wilf), so stretches of equal distance are runs with exact ends.  Windows
are compared by names made by doubling, not by hashes.  Work is n log^2 n a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import ensure
from .textkit import Words, mix, text_slices

#: A run has this many words and holds its period this many times, at least.
SHORTEST, TIMES = 6, 4
#: Lags up to this one are compared word by word.
SMALL_LAGS = 8
#: Splitting ends when it has counted this many times the words of a slice; the lag scan is exact on any segments.
SPLIT_WORK = 64


def _segments(pos: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number for each stretch of neighbouring positions of one text."""
    return np.cumsum(np.r_[False, (pos[1:] != pos[:-1] + 1) | (text[1:] != text[:-1])])


def surviving(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions within segments in which every word occurs TIMES times or more, in order, and a number for each segment."""
    pos, done, work = np.arange(len(word)), [], 0
    while len(pos) and work < SPLIT_WORK * len(word):
        work += len(pos)
        seg = _segments(pos, text[pos])
        _, kind, count = np.unique(seg * (int(word.max()) + 1) + word[pos], return_inverse=True, return_counts=True)
        often = count[kind] >= TIMES
        whole = np.ones(seg[-1] + 1, bool)
        whole[seg[~often]] = False
        stable = whole[seg]
        done.append(pos[stable])
        pos = pos[often & ~stable]
    pos = np.sort(np.concatenate([*done, pos]))
    if not len(pos):
        return pos, pos
    seg = _segments(pos, text[pos])
    pos = pos[np.bincount(seg)[seg] >= SHORTEST]
    return pos, _segments(pos, text[pos]) if len(pos) else pos


def _stretches(at: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers in ``at`` (with equal values of ``same``)."""
    if not len(at):
        return at, at
    new = at[1:] != at[:-1] + 1
    if same is not None:
        new |= same[1:] != same[:-1]
    edge = np.flatnonzero(new)
    return at[np.r_[0, edge + 1]], at[np.r_[edge, len(at) - 1]]


def _small_lags(value: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for q in range(1, min(SMALL_LAGS, len(value) // TIMES) + 1):
        k = np.arange(len(value) - q)
        first, last = _stretches(k[(value[:-q] == value[q:]) & (k + q < end[:-q])])
        size = last + 1 - first + q
        some = size >= max(SHORTEST, TIMES * q)
        yield first[some], size[some], np.full(some.sum(), q)


def _large_lags(value: np.ndarray, seg: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    name, width, home, low = value, 1, np.arange(len(value)), SMALL_LAGS + 1
    while True:
        keep = np.bincount(seg)[seg] >= TIMES * low if len(seg) else np.zeros(0, bool)
        if not keep.any():
            return
        name, seg, home = name[keep], np.unique(seg[keep], return_inverse=True)[1], home[keep]
        end = np.searchsorted(seg, seg, "right")
        high = low * 3 // 2
        window = 2 * high
        while 2 * width <= window:  # names of windows twice as wide; one that leaves its segment stays a window of its own
            k = np.flatnonzero(np.arange(len(name)) + 2 * width <= end)
            wider = np.full(len(name), -1)
            wider[k] = np.unique(name[k] * (len(name) + int(name.max()) + 2) + name[k + width], return_inverse=True)[1]
            name, width = wider, 2 * width
        k = np.flatnonzero(np.arange(len(name)) + window <= end)
        key = name[k] * (int(name.max(initial=0)) + 2) + name[k + window - width]
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]
        left, gap = k[order[:-1]][again], (k[order[1:]] - k[order[:-1]])[again]
        fits = (gap >= low) & (gap <= high) & (left + gap < end[left])
        left, gap = left[fits], gap[fits]
        by_place = np.argsort(left)
        left, gap = left[by_place], gap[by_place]
        first, last = _stretches(left, gap)
        q = gap[np.searchsorted(left, first)]
        size = last + window + q - first
        some = size >= TIMES * q
        yield home[first[some]], size[some], q[some]
        low = high + 1


def find_runs(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """All runs as rows (first word, length, period), by first word, then period; ``word`` numbers equal words alike, ``text`` tells texts apart."""
    pos, seg = surviving(word, text) if len(word) else (word, word)
    if not len(pos):
        return np.zeros((0, 3), np.int64)
    value, end = word[pos], np.searchsorted(seg, seg, "right")
    parts = [np.column_stack([pos[first], size, q]) for lags in (_small_lags(value, end), _large_lags(value, seg)) for first, size, q in lags]
    found = np.concatenate([np.zeros((0, 3), np.int64), *parts])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)  # a multiple of a run's period finds the same stretch
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _run_column(found: np.ndarray, begin: np.ndarray, home: np.ndarray) -> pa.Array:
    fields = [pa.array(found[:, 0] - begin[home]), pa.array(found[:, 1]), pa.array(found[:, 2])]
    edge = np.searchsorted(home, np.arange(len(begin) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def periodic_runs(docs: DataFrame, order: Callable[[str | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed, the words without repeats joined by one space.

    Of each run the words after its first period go.  ``order`` gives, for an id as
    text and a number of words, the numbers of the words to read in place of all
    (None: as they are).  One row for each row; null and empty texts have no words
    and no runs; ids may be null, repeated and of any type; extra columns are
    dropped.  A text is worked on whole, in memory that grows with its words.
    """
    docs = ensure(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = Words(part.column("text"))
                at, sizes = np.arange(len(words.start)), words.counts()
                if order is not None:
                    for i, name in enumerate(part.column("_name").to_pylist()):
                        if (read := order(name, int(sizes[i]))) is not None:
                            at[words.first[i] : words.first[i + 1]] = words.first[i] + read
                text = words.owner()
                _, word = np.unique(words.hashes()[at] ^ mix(text.astype(np.uint64)), return_inverse=True)
                found = find_runs(word, text)
                home = text[found[:, 0]]
                edge = np.zeros(len(word) + 1, np.int64)
                np.add.at(edge, found[:, 0] + found[:, 2], 1)
                np.add.at(edge, found[:, 0] + found[:, 1], -1)
                kept = np.cumsum(edge[:-1]) == 0
                changed = np.zeros(len(sizes), bool)
                changed[text[(at != np.arange(len(at))) | ~kept]] = True
                collapsed = []
                for i, held in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    own = (held or b"").split()  # bytes split at the same six separators
                    if changed[i]:
                        here = slice(words.first[i], words.first[i + 1])
                        own = [own[k] for k in (at[here][kept[here]] - words.first[i]).tolist()]
                    collapsed.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), _run_column(found, words.first[:-1], home), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
                )

    return docs.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: str = "runs"):
    """The run of greatest exact length / period; ties: smallest start, then period; null without runs."""
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda best, x: best.isNull() | (x.length * best.period > best.length * x.period)
    return F.aggregate(runs, nothing, lambda best, x: F.when(better(best, x), x).otherwise(best))


def looped(name: str | None, n: int) -> np.ndarray | None:
    """Word numbers of a text whose tail repeats: for one id in ten, from a word on, a cycle of words."""
    if name is None or not n or (h := zlib.crc32(name.encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), looped)
    best = found.select("doc_id", "runs", "collapsed", strongest().alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
