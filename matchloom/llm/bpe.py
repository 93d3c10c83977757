"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring byte symbols that stand side by side in no vocabulary token can
never end up in one token, so every such pair marks a certain cut.  A word is
cut there, the fragments are merged independently by rank, and the ids are
concatenated.  Results equal those of the public tokenizers library for files of
this kind: NFC, lower case, words by a pattern, byte-level symbols with a
word-end mark, special tokens taken out of the text first.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import ensure
from .textkit import text_slices

WORD_END = "</w>"
#: Words in each of the two generations of a worker's memory.
MEMORY = 200_000
#: Symbols of a fragment from which it is merged by itself.
LONG = 100
#: Largest tokenizer file that is sent to the executors, in bytes.
MOST_BYTES = 64 << 20
#: White space of Unicode, as a character class.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


_CONTROLS = re.compile("[\x1c-\x1f]")


class Vocabulary:
    """Tables of one tokenizer file, with a bounded memory of encoded words."""

    def __init__(self, content: str):
        held = json.loads(content)
        model = held["model"]
        if model.get("end_of_word_suffix") != WORD_END or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only word-end BPE files are supported")
        kinds = [n["type"] for n in held["normalizer"]["normalizers"]]
        split = held["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or held["decoder"] or held["post_processor"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("this normaliser, splitter or decoder isn't supported")
        vocab: dict[str, int] = model["vocab"]
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in held["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + WORD_END] for s in symbols]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(model["merges"])}
        self.merged = [vocab[a + b] for a, b in model["merges"]]
        self.none = len(self.merged)
        self.beside = set()
        for token in vocab:
            body = token.removesuffix(WORD_END) if token != WORD_END else token
            parts = [vocab[c] for c in body]
            if body != token and body:
                parts[-1] = vocab[body[-1] + WORD_END]
            self.beside.update(zip(parts, parts[1:], strict=False))
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.token_array = pa.array(self.tokens)
        # the same tables as arrays: symbols of bytes, which neighbours some token holds, ranks by pair
        self._inner, self._final = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self._beside = [np.array([[(a, b) in self.beside for b in right] for a in self.inner]) for right in (self.inner, self.final)]
        key = np.array([a << 32 | b for a, b in self.rank], np.int64)
        self._order = np.argsort(key)
        self._pairs, self._merged = key[self._order], np.array([*self.merged, -1], np.int64)

    def fragments(self, word: bytes) -> list[list[int]]:
        """The symbols of a word, cut where no token holds both neighbours."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        out, at = [], 0
        for i, pair in enumerate(zip(ids, ids[1:], strict=False), 1):
            if pair not in self.beside:
                out.append(ids[at:i])
                at = i
        return [*out, ids[at:]]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left, in time n log n."""
        n, get = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (x := get((ids[a], ids[after[a]]))) is not None:
                    heapq.heappush(heap, (x, a))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._order[at], self.none)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of many words, merged side by side.

        All fragments lie in one array; a round merges the leftmost pair of
        lowest rank of each fragment and lets go of those that have none left.
        """
        data = [w.encode() for w in words]
        if not data:
            return []
        raw = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        stop = np.cumsum([len(d) for d in data])
        last = np.zeros(len(raw), bool)
        last[stop - 1] = True
        sym = np.where(last, self._final[raw], self._inner[raw])
        beside = np.where(last[1:], self._beside[1][raw[:-1], raw[1:]], self._beside[0][raw[:-1], raw[1:]])
        begins = np.r_[True, last[:-1] | ~beside]
        seg = np.cumsum(begins) - 1
        home = np.repeat(np.arange(len(words)), np.diff(np.r_[0, stop]))[begins]  # of each fragment its word
        done_sym, done_seg = [], []
        size = np.bincount(seg)
        if (long := np.flatnonzero(size > LONG)).size:
            first = np.flatnonzero(begins)
            for f in long.tolist():
                ids = self._merge_long(sym[first[f] : first[f] + size[f]].tolist())
                done_sym.append(np.array(ids, np.int64))
                done_seg.append(np.full(len(ids), f))
            short = size[seg] <= LONG
            sym, seg = sym[short], seg[short]
        rank = np.full(len(sym), self.none)
        inside = np.flatnonzero(seg[1:] == seg[:-1])
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(seg)]))
            open_ = low < self.none
            done_sym.append(sym[~open_])
            done_seg.append(seg[~open_])
            sym, seg, rank, low = sym[open_], seg[open_], rank[open_], low[open_]
            if not len(sym):
                break
            at = np.flatnonzero(rank == low)
            at = at[np.r_[True, seg[at[1:]] != seg[at[:-1]]]]
            sym[at] = self._merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = self.none
            after = at[at + 1 < len(sym)]
            after = after[seg[after] == seg[after + 1]]
            rank[after] = self._ranks(sym[after], sym[after + 1])
            before = at[at > 0] - 1
            before = before[seg[before] == seg[before + 1]]
            rank[before] = self._ranks(sym[before], sym[before + 1])
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        ids = sym[order].astype("<u4").tobytes()
        edge = np.r_[0, np.cumsum(np.bincount(home[seg], minlength=len(words)))] * 4
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _runs(self, text: str) -> list[str]:
        """Lower-cased runs without white space; all else that is dropped between words is dropped here."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma lowers without regard to its place
        text = text.lower()
        # str.split also cuts at the four separators U+001C to U+001F, which the pattern keeps
        return self.words.findall(text) if _CONTROLS.search(text) else text.split()

    def encode_all(self, texts: list[str], specials: bool = True) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; without ``specials`` their strings are plain text.

        Words new to the worker are merged together.  Short ones are remembered
        in two generations: when the young one is full it becomes the old one,
        and words met again come back, so common words stay.
        """
        parts: list[list[list[str] | str]] = []
        for text in texts:
            if specials and self.specials is not None and any(t in text for t in self.special):
                parts.append([p if p in self.special else self._runs(p) for p in self.specials.split(text) if p])
            else:
                parts.append([self._runs(text)])
        if len(self.memory) >= MEMORY:
            self.older, self.memory = self.memory, {}
        passing = self._learn(set().union(*[p for own in parts for p in own if not isinstance(p, str)]))
        get = self.memory.__getitem__
        out = [b"".join([struct.pack("<I", self.special[p]) if isinstance(p, str) else b"".join(map(get, p)) for p in own]) for own in parts]
        for w in passing:
            del self.memory[w]
        return out

    def _learn(self, runs: set[str]) -> list[str]:
        """Puts the ids of all runs into the young memory and names the long ones, which aren't to stay; a run with signs in it is put together from its words."""
        memory, older = self.memory, self.older
        missing = runs.difference(memory)
        known = missing.intersection(older)
        memory.update(zip(known, map(older.__getitem__, known), strict=True))
        missing -= known
        signs = {w: self.words.findall(w) for w in missing if not w.isalpha()}
        words = missing.difference(signs).union(*signs.values()).difference(memory)
        for w in words.intersection(older):
            memory[w] = older[w]
        new = list(words.difference(memory))
        memory.update(zip(new, self._words(new), strict=True))
        get = memory.__getitem__
        joined = {w: b"".join(map(get, own)) for w, own in signs.items()}
        memory.update(joined)
        return [w for w in {*new, *joined} if len(w) > 64]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens, special ones included, with a space between them."""
        return self.decode_all([ids])[0].as_py()

    def decode_all(self, ids: list[bytes]) -> pa.Array:
        """`decode` of many rows at once: tokens are taken and joined by Arrow."""
        edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        tokens = self.token_array.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), tokens), " ")


@lru_cache(2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def _sent(df: DataFrame, tokenizer: str | None):
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError("this tokenizer file is too large to send")
    return df.sparkSession.sparkContext.broadcast(content)


def _added(part: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *columns.values()], [*part.schema.names, *columns])


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The ``keep`` columns of docs, n_tokens (long), ids (binary, little-endian unsigned 32-bit) and, on demand, decoded.

    One row for each row, repeated ones too.  Null and empty texts have no
    tokens.  Extra columns are dropped unless kept by name.  A word of any length
    is encoded whole, in time n log n.  ``decoded`` is what `decode` makes of the
    ids, made in the same pass so that one worker holds the tables, not two.
    """
    docs, sent = ensure(docs, *keep, text), _sent(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            for part in text_slices(batch, text):
                ids = vocabulary.encode_all([t or "" for t in part.column(text).to_pylist()])
                more = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    more["decoded"] = vocabulary.decode_all(ids)
                yield _added(part.select(list(keep)), more)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_tokens long", "ids binary", *["decoded string"] * decoded]))


def encode_columns(df: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...], tokenizer: str | None = None) -> DataFrame:
    """The ``keep`` columns of df, and ids_<name> (array of int) for each of several text columns, in one pass with one vocabulary a worker.

    Strings of special tokens are plain text here, so texts can't bring control ids in.  Null and empty texts give empty arrays.
    """
    df, sent = ensure(df, *keep, *columns), _sent(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            for part in _all_sliced(batch, columns):
                more = {}
                for name in columns:
                    ids = vocabulary.encode_all([t or "" for t in part.column(name).to_pylist()], specials=False)
                    edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    more[f"ids_{name}"] = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                yield _added(part.select(list(keep)), more)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in keep]).schema]
    return df.mapInArrow(run, ", ".join([*kinds, *[f"ids_{c} array<int>" for c in columns]]))


def _all_sliced(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if not columns:
        yield batch
        return
    for part in text_slices(batch, columns[0]):
        yield from _all_sliced(part, columns[1:])


def vocabulary_size(tokenizer: str | None = None) -> int:
    """One more than the largest id."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        held = json.load(f)
    return 1 + max([*held["model"]["vocab"].values(), *[t["id"] for t in held["added_tokens"]]])


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """encoded(ids, ...) with a column decoded: tokens joined by one space, as the file names no decoder.  Null ids: empty."""
    sent = _sent(encoded, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(sent.value)
        for batch in batches:
            for part in text_slices(batch, "ids"):
                yield _added(part, {"decoded": vocabulary.decode_all([x or b"" for x in part.column("ids").to_pylist()])})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    return encoded.mapInArrow(run, ", ".join([*kinds, "decoded string"]))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
