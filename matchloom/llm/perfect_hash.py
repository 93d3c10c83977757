"""Minimal perfect hashing of distinct 64-bit keys by levels of bit arrays.

A level hashes the keys that are left to about twice as many bits; keys alone at
their bit are placed, and their bit stays set, the others go to the next level.
A key's slot is the number of set bits before its own over all levels, so n keys
have the slots 0 to n - 1 at three to four bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

from .textkit import mix

_SPREAD = 2.0


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(bits)).astype(np.int64)


def build(keys: np.ndarray) -> bytes:
    """The hash of distinct unsigned 64-bit keys, as bytes."""
    left, levels = keys, []
    while len(left):
        bits = max(64, int(_SPREAD * len(left)))
        at = _places(left, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 200:
            raise ValueError("keys must be distinct")
    return struct.pack(f"<I{len(levels)}I", len(levels), *map(len, levels)) + b"".join(np.packbits(x).tobytes() for x in levels)


class PerfectHash:
    """Slots of keys.  A key outside the set gets any slot or -1, so its slot's key must be compared."""

    def __init__(self, held: bytes):
        (n,) = struct.unpack_from("<I", held)
        sizes, at = struct.unpack_from(f"<{n}I", held, 4), 4 + 4 * n
        self.levels, before = [], 0
        for bits in sizes:
            many = (bits + 7) // 8
            alone = np.unpackbits(np.frombuffer(held, np.uint8, many, at), count=bits).astype(bool)
            rank = np.cumsum(alone, dtype=np.int32) - 1 + before
            self.levels.append((alone, rank))
            before, at = before + int(alone.sum()), at + many
        self.size = before

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = _places(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out
