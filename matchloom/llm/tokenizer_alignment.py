"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the token pairs that overlap.

A text is cut before each single space that follows a visible character: neither
tokenizer can join what lies on both sides, so such a chunk has the same tokens
anywhere, and a worker encodes each distinct one once.  The ids are written.  A
first pass aligns them and counts linked pairs for each task.  The distinct pairs are dealt into shards of bounded size,
and each shard gets a minimal perfect hash.  Counts become dense vectors indexed
by it, one for a few tasks, which are summed along a tree.  A second pass aligns
the documents again and looks counts up by hash, with the slot's key verified.
The most frequent pairs, up to a bound, are sent to the workers; a link of any
other pair finds its count by a join.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MOST_BYTES, byte_symbols
from .perfect_hash import PerfectHash, build
from .stage import cut, ensure
from .textkit import SEGMENT, mix, text_slices

#: Distinct pairs in a shard on average.
SHARD = 1 << 14
#: Tasks whose counts make one vector, and vectors that are summed at a time.
FAN = 16
#: Pairs that are sent to every worker at most, about 20 bytes each.
HEAD = 1 << 21
#: Chunks of at most 64 characters that a worker remembers, and pairs it counts before it hands them on.
MEMORY, MOST_PAIRS = 200_000, 1 << 20
#: Characters below this one are classed alike by all versions of Unicode, so the quicker encoder may have them.
_PLAIN = "\u0250"
_CUT = re.compile(r"(?<=\S) (?!\Z)")
_BLANKS = [f"{c} " for c in map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def chunks(text: str) -> list[str]:
    """The chunks of a text that isn't empty, each without the space before it."""
    if text[0] == " " or text[-1] == " " or any(b in text for b in (_BLANKS[:10] if text.isascii() else _BLANKS)):
        return _CUT.split(text)
    return text.split(" ")


class Aligner:
    """Both tokenizers, and the tokens of the chunks seen lately."""

    def __init__(self, bytes_file: str, pieces_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        held = json.loads(bytes_file)
        before = held["pre_tokenizer"]
        if held["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("the first tokenizer must be a plain byte-level one")
        self.a = Tokenizer.from_str(bytes_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte, names = {s: b for b, s in enumerate(byte_symbols())}, self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(names.values()))
        for t, i in names.items():
            self.a_bytes[i] = bytes(byte.get(c, 63) for c in t)
        self.quick = _by_rank(held["model"], self.a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces) or not pieces[self.b.encode("a")[0]].startswith("▁"):
            raise ValueError("the second tokenizer must mark spaces at the beginning of pieces only, and add one")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        self.memory: dict[str, tuple[bytes, bytes] | None] = {}
        self.decimals = _decimals(max(len(self.a_bytes), len(self.b_bytes)))

    def _encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and the text; None where their bytes aren't those."""
        held = f" {text}".encode()
        quick = self.quick and (text.isascii() or max(text) < _PLAIN)
        a = self.quick.encode_ordinary(f" {text}") if quick else self.a.encode(f" {text}", add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        same = b"".join([self.a_bytes[i] for i in a]) == held and b"".join([self.b_bytes[i] for i in b]) == held
        return (a, b) if same else None

    def _packed(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()

    def _together(self, some: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Tokens of chunks that end in a visible character, encoded in one go and cut at the chunks' ends."""
        if not (both := self._encoded(" ".join(some))):
            return {c: self._packed(*one) if (one := self._encoded(c)) else None for c in some}
        end, parts = np.cumsum([1 + len(c.encode()) for c in some]), []
        for ids, size in zip(both, (self.a_size, self.b_size), strict=True):
            ids = np.array(ids, np.int64)
            edge = [0, *(np.searchsorted(np.cumsum(size[ids]), end) + 1).tolist()]
            raw, wide = ids.astype(self.kind).tobytes(), self.kind.itemsize
            parts.append([raw[wide * x : wide * y] for x, y in zip(edge[:-1], edge[1:], strict=True)])
        return dict(zip(some, zip(*parts, strict=True), strict=True))

    def table(self, wanted: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each of some distinct chunks by both; None where the tokens' bytes aren't the chunk's."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory, made = self.memory, {}
        new = [c for c in wanted if c not in memory]
        plain = [c for c in new if len(c) <= 64 and not c[-1].isspace() and "▁" not in c]
        latin = {c for c in plain if c.isascii() or max(c) < _PLAIN}
        for some in (list(latin), [c for c in plain if c not in latin]):
            for at in range(0, len(some), 4000):
                memory.update(self._together(some[at : at + 4000]))
        for c in new:
            if c not in memory:
                made[c] = self._packed(*one) if (one := self._encoded(c)) else None
        return [memory[c] if c in memory else made[c] for c in wanted]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text the number of its first ids as 8 bytes, those, and the other ids; nothing where it has no tokens."""
        held = [chunks(t) if t else [] for t in texts]
        at: dict[str, int] = {}
        number = [[at.setdefault(c, len(at)) for c in own] for own in held]
        rows = self.table(list(at))
        bad = {i for i, r in enumerate(rows) if r is None}
        first, second, out, wide = [r and r[0] for r in rows], [r and r[1] for r in rows], [], self.kind.itemsize
        for own in number:
            if not own or (bad and not bad.isdisjoint(own)):
                out.append(b"")
            else:
                a = b"".join([first[k] for k in own])
                out.append(struct.pack("<q", len(a) // wide) + a + b"".join([second[k] for k in own]))
        return out


def _by_rank(model: dict, tokens: list[bytes]):
    """The same tokenizer by ranks, which is quicker; None where ids aren't in the order of merges."""
    import public_tokenizers
    import tiktoken

    bare = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    if sorted(map(len, tokens[:256])) != [1] * 256 or any(model["vocab"].get(t) != 256 + i for i, t in enumerate(bare)):
        return None
    return tiktoken.Encoding("by-rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(bare)])}, special_tokens={})


def _decimals(n: int) -> pa.Array:
    """Decimal numbers below n followed by nothing, a comma, a bar or a semicolon, one kind after the other."""
    return pa.array([f"{i}{end}" for end in ("", ",", "|", ";") for i in range(n)], pa.large_string())


class Aligned:
    """The aligned tokens of some documents.

    The byte ranges of both sides are laid end to end.  Every distinct end of a
    token ends one link, of the tokens that cover the bytes before it; an end that
    both sides share ends a group.
    """

    def __init__(self, aligner: Aligner, held: list[bytes]):
        kind, self.aligner = aligner.kind, aligner
        n = np.array([struct.unpack_from("<q", x)[0] if x else 0 for x in held], np.int64)
        total = np.array([(len(x) - 8) // kind.itemsize if x else 0 for x in held], np.int64)
        raw = np.frombuffer(b"".join([x[8:] for x in held]), kind).astype(np.int64)
        self.n_a, self.n_b = n, total - n
        left = np.repeat(np.tile([True, False], len(held)), np.column_stack([n, total - n]).ravel())
        self.a, self.b = raw[left], raw[~left]
        self.a_end, self.b_end = np.cumsum(aligner.a_size[self.a]), np.cumsum(aligner.b_size[self.b])
        both = np.sort(np.concatenate([self.a_end, self.b_end]), kind="stable")  # two runs to merge
        new = np.r_[True, both[1:] != both[:-1]][: len(both)]
        self.end, self.closes = both[new], np.diff(np.r_[np.flatnonzero(new), len(both)]) == 2
        self.at_a, self.at_b = np.searchsorted(self.a_end, self.end), np.searchsorted(self.b_end, self.end)
        self.pairs = self.a[self.at_a] << 32 | self.b[self.at_b]
        # the last link of each document
        last = np.r_[0, self.a_end][np.cumsum(n)]
        self.first = np.r_[0, np.searchsorted(self.end, last, "right")]

    def sums(self, value: np.ndarray) -> np.ndarray:
        """For each document the sum of a value of its links."""
        total = np.r_[0, np.cumsum(value)]
        return total[self.first[1:]] - total[self.first[:-1]]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and the number of their links."""
        pair, n = np.unique(self.pairs, return_counts=True)
        return pair, n.astype(np.int64)

    def groups(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        ends = self.end[self.closes]
        a_group, b_group = np.searchsorted(ends, self.a_end), np.searchsorted(ends, self.b_end)
        many_a, many_b = (np.bincount(g, minlength=len(ends)) for g in (a_group, b_group))
        upto_a, upto_b = np.cumsum(many_a), np.cumsum(many_b)
        total = len(self.a) + len(self.b)
        kind, token = np.ones(total, np.int64), np.empty(total, np.int64)
        token[np.arange(len(self.a)) + (upto_b - many_b)[a_group]] = self.a
        token[np.arange(len(self.b)) + upto_a[b_group]] = self.b
        kind[upto_a + (upto_b - many_b) - 1] = 2
        kind[upto_a + upto_b - 1] = 3
        edge = np.r_[0, np.cumsum(self.n_a + self.n_b)]
        kind[edge[1:][edge[1:] > edge[:-1]] - 1] = 0
        text = self.aligner.decimals.take(pa.array(kind * (len(self.aligner.decimals) // 4) + token))
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, np.int64)[: total + 1] if offsets is not None and total else np.zeros(total + 1, np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(edge) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[edge])), data if data is not None else pa.py_buffer(b"")])


@lru_cache(1)
def _aligner(bytes_file: str, pieces_file: bytes) -> Aligner:
    return Aligner(bytes_file, pieces_file)


def _sent_files(df: DataFrame, bytes_file: str | None, pieces_file: str | None):
    if not bytes_file or not pieces_file:
        import public_tokenizers

        bytes_file, pieces_file = bytes_file or public_tokenizers.path("byte_bpe_50k.json"), pieces_file or public_tokenizers.path("piece_bpe_32k.model")
    held = []
    for name in (bytes_file, pieces_file):
        with open(name, "rb") as f:
            held.append(f.read(MOST_BYTES + 1))
        if len(held[-1]) > MOST_BYTES:
            raise ValueError("this tokenizer file is too large to send")
    return df.sparkSession.sparkContext.broadcast((held[0].decode(), held[1]))


def encoded(docs: DataFrame, sent) -> DataFrame:
    """doc_id and tokens, compressed ids by both tokenizers, of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pack = _aligner(*sent.value), zstandard.ZstdCompressor(1).compress
        for batch in batches:
            for part in text_slices(batch, "text"):
                held = aligner.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([pack(x) if x else b"" for x in held], pa.binary())], ["doc_id", "tokens"])

    return docs.mapInArrow(run, f"doc_id {kind}, tokens binary")


def _slices(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in text_slices(batch, "tokens", SEGMENT // 2):
            yield part, Aligned(aligner, [unpack(x) if x else b"" for x in part.column("tokens").to_pylist()])


def _merged(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(pair, return_inverse=True)
    return kinds, np.bincount(at, n, len(kinds)).astype(np.int64)


def _fine(pair: np.ndarray) -> np.ndarray:
    return (mix(pair.view(np.uint64)) >> np.uint64(48)).astype(np.int32)


def task_counts(tokens: DataFrame, sent) -> DataFrame:
    """_task, pair (first id shifted by 32, then the second), _fine (its hash in 16 bits), n: links of a pair in the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, many = TaskContext.get().partitionId(), [], 0

        def out() -> pa.RecordBatch:
            pair, n = _merged(*map(np.concatenate, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), task, np.int32)), pa.array(pair), pa.array(_fine(pair)), pa.array(n)], ["_task", "pair", "_fine", "n"])

        for _, aligned in _slices(batches, _aligner(*sent.value)):
            held.append(aligned.counts())
            many += len(held[-1][0])
            if many > MOST_PAIRS:
                held = [_merged(*map(np.concatenate, zip(*held, strict=True)))]
                many = len(held[0][0])
                if 2 * many > MOST_PAIRS:
                    yield out()
                    held, many = [], 0
        if held:
            yield out()

    return tokens.mapInArrow(run, "_task int, pair long, _fine int, n long")


def _hashed(pairs: DataFrame, shards: int) -> DataFrame:
    """_shard, hash, keys (in the order of their slots) of distinct pairs."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("pair").to_numpy().view(np.uint64)
        held = build(keys)
        ordered = np.empty_like(keys)
        ordered[PerfectHash(held).slots(keys)] = keys
        return pa.table({"_shard": table.column("_shard").slice(0, 1), "hash": pa.array([held]), "keys": pa.array([ordered.tobytes()])})

    return pairs.select(_shard_of(shards), "pair").groupBy("_shard").applyInArrow(run, "_shard long, hash binary, keys binary")


def _shard_of(shards: int):
    return F.pmod(F.col("_fine"), F.lit(shards)).cast("long").alias("_shard")


def _vectors(counts: DataFrame, hashed: DataFrame, shards: int, leaves: int) -> DataFrame:
    """_shard, _leaf, vector: dense counts by slot of the tasks of a leaf."""

    def run(table: pa.Table, tools: pa.Table) -> pa.Table:
        if not tools.num_rows or not table.num_rows:
            return _VECTORS.empty_table()
        keys, held = np.frombuffer(tools.column("keys")[0].as_py(), np.uint64), PerfectHash(tools.column("hash")[0].as_py())
        pair = table.column("pair").to_numpy().view(np.uint64)
        slot = held.slots(pair)
        if (keys[slot] != pair).any():
            raise ValueError("a pair isn't among the hashed ones")
        vector = np.zeros(len(keys), np.int64)
        np.add.at(vector, slot, table.column("n").to_numpy())
        return pa.table([tools.column("_shard").slice(0, 1), tools.column("_leaf").slice(0, 1), pa.array([zlib.compress(vector.tobytes(), 1)])], _VECTORS)

    dealt = counts.select(_shard_of(shards), F.expr(f"cast(_task div {FAN} as int)").alias("_leaf"), "pair", "n")
    tools = hashed.withColumn("_leaf", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))))
    return dealt.groupBy("_shard", "_leaf").cogroup(tools.groupBy("_shard", "_leaf")).applyInArrow(run, "_shard long, _leaf int, vector binary")


_VECTORS = pa.schema([("_shard", pa.int64()), ("_leaf", pa.int32()), ("vector", pa.binary())])


def _summed(vectors: DataFrame) -> DataFrame:
    """One level of the tree: FAN vectors become one."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(v), np.int64) for v in table.column("vector").to_pylist())
        return pa.table([table.column("_shard").slice(0, 1), table.column("_leaf").slice(0, 1), pa.array([zlib.compress(total.tobytes(), 1)])], _VECTORS)

    up = vectors.withColumn("_leaf", F.expr(f"cast(_leaf div {FAN} as int)"))
    return up.groupBy("_shard", "_leaf").applyInArrow(run, "_shard long, _leaf int, vector binary")


def pair_counts(counts: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(_shard, hash, keys, vector) of task counts, with dense counts by slot, and the number of shards; no pairs, no rows."""
    counts = cut(counts)
    pairs = cut(counts.select("pair", "_fine").distinct())
    shards = min(1 << 16, max(1, math.ceil(pairs.count() / shard)))
    hashed = cut(_hashed(pairs, shards))
    leaves = 1 + (counts.agg(F.max("_task")).first()[0] or 0) // FAN
    vectors = cut(_vectors(counts, hashed, shards, leaves))
    while leaves > 1:
        vectors, leaves = cut(_summed(vectors)), math.ceil(leaves / FAN)
    return cut(hashed.hint("merge").join(vectors.select("_shard", "vector").hint("merge"), "_shard")), shards


def _long_form(totals: DataFrame) -> DataFrame:
    """pair, _fine, n of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, vector in zip(batch.column("keys").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                pair = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(_fine(pair)), pa.array(np.frombuffer(zlib.decompress(vector), np.int64))], ["pair", "_fine", "n"])

    return totals.mapInArrow(run, "pair long, _fine int, n long")


class _Lookup:
    """Counts of the pairs that were sent, by hash and verified key."""

    def __init__(self, rows: list[tuple], shards: int, highest: np.ndarray):
        self.shards, self.highest = shards, highest
        self.held = {s: (PerfectHash(h), np.frombuffer(k, np.int64), np.frombuffer(zlib.decompress(v), np.int64)) for s, h, k, v in rows}

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, -1 where it wasn't sent."""
        out, shard = np.full(len(pairs), -1), _fine(pairs) % self.shards
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (held, keys, n) in self.held.items():
            own = order[edge[s] : edge[s + 1]]
            slot = held.slots(pairs[own].view(np.uint64))
            hit = (slot >= 0) & (keys[slot] == pairs[own])
            out[own[hit]] = n[slot[hit]]
        return out


_LOOKUP: dict = {}


def _lookup(sent) -> _Lookup:
    """The worker's table of a broadcast, made once."""
    name, *held = sent.value
    if name not in _LOOKUP:
        _LOOKUP.clear()
        _LOOKUP[name] = _Lookup(*held)
    return _LOOKUP[name]


def align(docs: DataFrame, bytes_file: str | None = None, pieces_file: str | None = None, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;...``) of every document.

    Null and empty texts, and texts whose tokens don't give back their bytes, have
    no tokens: zeros and an empty text.  One row for each row; ids may be null,
    repeated and of any type; extra columns are dropped.  ``head`` bounds the pairs
    that are sent to the workers; results don't depend on it.
    """
    docs = ensure(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent, context = _sent_files(docs, bytes_file, pieces_file), docs.sparkSession.sparkContext
    tokens = cut(encoded(docs, sent))
    totals, shards = pair_counts(task_counts(tokens.select("tokens"), sent), shard)
    table = _long_form(totals)
    highest = np.zeros(1, np.int64)
    # one row for each id of the second vocabulary at most
    top = table.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).collect()
    if top:
        highest = np.zeros(1 + max(r.b for r in top), np.int64)
        highest[[r.b for r in top]] = [r.n for r in top]
    # how many pairs have a count of each power of two: 64 rows at most
    by_power = {r.power: r.many for r in table.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("many")).collect()}
    least, many = 0, sum(by_power.values())
    for power in sorted(by_power):
        if many <= head:
            break
        many, least = many - by_power[power], 1 << (power + 1)
    chosen, rest = totals, None
    if least:  # more pairs than may be sent: the most frequent ones get a hash of their own
        frequent = cut(table.filter(F.col("n") >= least).withColumn("_task", F.lit(0)))
        (chosen, shards), rest = pair_counts(frequent, shard), table.filter(F.col("n") < least).select("pair", "n")
    rows = [(r["_shard"], bytes(r["hash"]), bytes(r["keys"]), bytes(r["vector"])) for r in chosen.collect()]
    by_join = rest is not None
    counts = context.broadcast((uuid.uuid4().hex, rows, shards, highest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(counts)
        for part, own in _slices(batches, _aligner(*sent.value)):
            n = lookup.find(own.pairs)
            best = n == lookup.highest[np.minimum(own.pairs & 0xFFFFFFFF, len(lookup.highest) - 1)]
            sums = [own.n_a, own.n_b, *map(own.sums, (own.closes, np.ones(len(n), np.int64), best & (n > 0), np.maximum(n, 0)))]
            more = []
            if by_join:
                unknown, edge = own.pairs[n < 0], np.r_[0, np.cumsum(own.sums(n < 0))]
                more = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(unknown))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, sums), own.groups().cast(pa.string()), *more], [*_NAMES, *["_rest"] * len(more)])

    kinds = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    if not by_join:
        return tokens.mapInArrow(run, kinds)
    found = cut(tokens.mapInArrow(run, f"{kinds}, _rest array<long>")).withColumn("_key", F.monotonically_increasing_id())  # the checkpoint fixes the order
    most = context.broadcast(highest)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = batch.column("n").to_numpy() == most.value[batch.column("pair").to_numpy() & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int64))], ["pair", "n", "best"])

    wanted = found.select("_key", F.explode("_rest").alias("pair")).groupBy("_key", "pair").agg(F.count("*").alias("times"))
    met = wanted.hint("merge").join(rest.mapInArrow(judged, "pair long, n long, best long").hint("merge"), "pair")
    added = met.groupBy("_key").agg(F.sum(F.expr("times * n")).alias("_n"), F.sum(F.expr("times * best")).alias("_best"))
    both = found.drop("_rest").hint("merge").join(added.hint("merge"), "_key", "left")
    plus = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_n"), "groups")


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select(*_NAMES[:-1], digest.alias("groups_sha256"))
