"""Vectorised word spans and Karp-Rabin hashes over Arrow string columns.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r.  All separators
are ASCII, so working on UTF-8 bytes gives exactly the words of the text.  A
word's hash chains a bijective mixer over its 8-byte blocks, so words of one
block never collide before their length is mixed in; very long words take XXH64.
Window hashes are polynomials in word hashes, which have no structure that a
polynomial modulo 2**64 could be fooled by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEGMENT = 1 << 21

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 256
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every bit of h over the whole word."""
    h = h + _GOLD
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(batch: pa.RecordBatch, column: str, most: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Row slices of batch whose texts together hold about ``most`` bytes (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        below = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, below + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty), and where each text begins, with the end appended."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """Words of several texts: byte spans, and ``first[i]:first[i + 1]`` as the words of text i."""

    __slots__ = ("raw", "off", "start", "end", "first", "_hashes")

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None):
        self.raw, self.off = utf8(texts)
        if table is not None:
            self.raw = table[self.raw]
        inside = ~_IS_SEP[self.raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.off[:-1][self.off[:-1] < len(inside)]
        begins[edge] = inside[edge]
        edge = self.off[1:][self.off[1:] > 0] - 1
        ends[edge] = inside[edge]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.off)
        self._hashes: np.ndarray | None = None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """One mixed 64-bit hash a word, made once."""
        if self._hashes is not None:
            return self._hashes
        size = self.end - self.start
        out = mix(size.astype(np.uint64))
        blocks = np.ndarray(len(self.raw), "<u8", np.concatenate([self.raw, np.zeros(8, np.uint8)]), strides=(1,))  # the 8 bytes from each place on
        some, at = np.flatnonzero(size <= _LONG_WORD), 0
        while len(some):
            left = size[some] - at
            out[some] = mix(out[some] ^ (blocks[self.start[some] + at] & _KEEP[np.minimum(left, 8)]))
            at += 8
            some = some[left > 8]
        for i in np.flatnonzero(size > _LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(self.raw[self.start[i] : self.end[i]].tobytes(), 42)
        self._hashes = out
        return out

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Karp-Rabin hashes of every n consecutive words of one text, and the index of each first word."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for j in range(n):
            total *= np.uint64(_BASE)
            total += hashes[j : len(hashes) - n + 1 + j]
        left = np.repeat(self.first[1:], self.counts())[: len(total)] - np.arange(len(total))
        whole = left >= n
        return mix(total[whole]), np.flatnonzero(whole)
