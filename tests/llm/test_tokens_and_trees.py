"""op6, op8, op10: exact round trips, the tokenizers library, and the placement law."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import xxhash

from matchloom.llm import bpe as B
from matchloom.llm import chat_prefix_tree as P
from matchloom.llm import sharding as H


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(1)
    pool = "aàáÉéΣσςİßǅﬁＡ1²½٣中文🎉👩‍👩 \t\n\x85\u2003\u3000\xa0\x1c\x1f\x00'sT're|<>endoftexţ́e​ x"
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    return [*out, "", "<|endoftext|>", "a<|endoftext|>b<|startoftext|> <|endoftext|", "x" * 5000, "ab" * 3000 + " z", "don't WE'LL i'VE 'S", "ΣΑΣ ΟΔΟΣ"]


def test_encoding_equals_the_library():
    t, content = reference(), open(B.default_tokenizer(), encoding="utf-8").read()
    v = B.Vocabulary(content)
    together = B.Vocabulary(content).encode_all(texts())
    for text, both in zip(texts(), together, strict=True):
        ids, want = v.encode(text), t.encode(text, add_special_tokens=False).ids
        assert ids == both and list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, repr(text)
        assert v.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_cuts_are_certain():
    v = B.Vocabulary(open(B.default_tokenizer(), encoding="utf-8").read())
    for word in ("中文x", "naïve", "abc", "\x00\x01q"):
        parts = v.fragments(word.encode())
        assert sum(map(len, parts)) == len(word.encode())
        for a, b in zip(parts, parts[1:], strict=False):
            assert (a[-1], b[0]) not in v.beside and (a[-1], b[0]) not in v.rank
    assert len(v.fragments("中文x".encode())) > 1


def test_bpe_frames(spark, sf):
    t = reference()
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "Hello, World", "y"), (2, "a" * 300_000, "z")], "doc_id long, text string, ids string")
    got = B.decode(B.encode(df)).collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[2].decoded == t.decode(t.encode("Hello, World", add_special_tokens=False).ids, skip_special_tokens=False)
    assert got[3].n_tokens == len(t.encode("a" * 300_000, add_special_tokens=False).ids)
    assert B.decode(B.encode(df.limit(0))).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in B.op8_bpe(spark, sf).collect():
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_trees(spark):
    rnd, rows = random.Random(2), []
    for c in [*range(60), None]:
        for t in range(rnd.randint(1, 5)):
            role = rnd.choice(["user", "assistant", None, "sys\ntem<s>\\"]) if t > 1 else "user"
            rows.append((c, t, role, rnd.choice(["a", "b", "</s>[INST] ok [/INST]", "\\", "<\\<s>\\\\", "", None, "<|im_end|>\n", "x<|im_start|>user\ny", "é中🎉"]), "clash"))
        if rnd.random() < 0.2:
            rows.append(rows[-1])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")
    segments, members = P.build(df)
    out = {r.conv_id: r for r in P.read_back(segments, members).collect()}
    conv = {}
    for c, t, r, x, _ in rows:
        conv.setdefault(c, []).append((t, r, x))
    for c, turns in conv.items():
        turns.sort(key=lambda z: tuple((q is not None, q) for q in z))
        assert [(t.role, t.text) for t in out[c].turns] == [(r or "", x or "") for _, r, x in turns]
        assert out[c].loss_text == "".join(x or "" for _, r, x in turns if r == "assistant")
        assert not any(s in out[c].formatted for s in P.CONTROLS[2:])
    seg, by = segments.collect(), {}
    for s in seg:
        by.setdefault(s.tree, []).append(s)
    prefixes = set()
    for turns in conv.values():
        prefixes |= {tuple((r or "", x or "") for _, r, x in turns[: i + 1]) for i in range(len(turns))}
    one_turn = lambda p: len(P_text(p[-1]))
    assert sum(len(s.text) for s in seg) == sum(one_turn(p) for p in prefixes)  # every shared turn stands there once
    for tree in by.values():
        tree.sort(key=lambda s: s.start)
        at, stack = 0, []
        for s in tree:
            assert s.start == at and s.end - s.start == len(s.text)
            at = s.end
            stack = stack[: s.depth - 1]  # depth first: the open path is the ancestors
            assert [(a.start, a.end) for a in s.attends] == stack and sum(b - a for a, b in stack) == s.position
            stack.append((s.start, s.end))
    # the same in tokens: a path's segments give the ids of the whole conversation, its positions and its loss mask
    t, size = reference(), B.vocabulary_size()
    enc = lambda x: t.encode(x or "", add_special_tokens=False).ids
    for tree in by.values():
        at, stack = 0, []
        for s in tree:
            assert s.token_start == at and s.token_end - s.token_start == len(s.ids)
            at, stack = s.token_end, stack[: s.depth - 1]
            assert [(a.start, a.end) for a in s.token_attends] == stack and sum(b - a for a, b in stack) == s.token_position
            stack.append((s.token_start, s.token_end))
    keyed, paths = {(s.k1, s.k2): s for s in seg}, {}
    for m in members.collect():
        paths.setdefault(m.conv_id, []).append((m.segment, keyed[m.k1, m.k2]))
    for c, turns in conv.items():
        path = [s for _, s in sorted(paths[c], key=lambda x: x[0])]
        assert [i for s in path for i in s.ids] == [i for _, r, x in turns for i in [size, *enc(r), *enc(x), size + 1]]
        assert [i for s in path for a in s.token_loss for i in s.ids[a.start : a.end]] == [i for _, r, x in turns if r == "assistant" for i in enc(x)]
    assert P.read_back(*P.build(df.limit(0))).count() == 0


def test_special_tokens_in_turns_are_plain_text(spark):
    special = next(iter(B.Vocabulary(open(B.default_tokenizer(), encoding="utf-8").read()).special.items()))
    got = P.build(spark.createDataFrame([(1, 0, "user", f"a {special[0]} b"), (1, 1, special[0], None)], "conv_id long, turn int, role string, text string"))[0].collect()
    assert len(got) == 1 and special[1] not in got[0].ids and [got[0].ids.count(B.vocabulary_size() + i) for i in (0, 1)] == [2, 2]


def P_text(turn):
    import re

    esc = lambda x: re.sub(r"\\|<(?=\|im_start\|>|\|im_end\|>|/?s>|</?SYS>>)|\[(?=/?INST\])", lambda m: m.group() + "\\", x)
    return P.OPEN + esc(turn[0]).replace("\n", "<\\n>") + "\n" + esc(turn[1]) + P.CLOSE


def test_chat_query(spark, sf):
    import duckdb

    got = sorted(tuple(r) for r in P.op6_chat_prefix_tree(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    result = con.execute(P.OP6_SQL)
    assert [d[0] for d in result.description] == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert got == sorted(tuple(r) for r in result.fetchall())


def slow_place(key, tree):
    path, kids = "", H.children(tree)
    for _ in range(3):
        best = []
        for name, weight in kids[path]:
            p = f"{path}/{name}"
            h = xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
            best.append((-math.log(((h >> 11) + 0.5) / 2**53) / weight, name))
        path += "/" + min(best)[1]
    return int(path.rsplit("/", 1)[1])


def test_sharding(spark):
    rows = [(i, f"t{i % 7}" * (i % 5), 1) for i in range(3000)] + [(None, None, 2), (None, "é", 2), (5, "t5", 1), (5, "t5", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = H.shard(df, 8, blocks=16).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.shard == slow_place(r.doc_id, H.fleet(8)) and r.grown_shard == slow_place(r.doc_id, H.fleet(9))
        assert r.grown_shard in (r.shard, 8)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) < 1.3 * min(sizes.values()) and 250 < sum(r.grown_shard == 8 for r in got) < 420
    assert H.shard(df.limit(0)).count() == 0


def test_growth_moves_rows_only_into_the_new_shard():
    for n in range(8, 14):
        for key in range(400):
            a, b = slow_place(key, H.fleet(n)), slow_place(key, H.fleet(n + 1))
            assert b in (a, n)


def test_weight_change_moves_rows_only_to_what_grew():
    light = [s._replace(weight=1.0) for s in H.fleet(8)]
    heavy = [s._replace(weight=3.0 if s.shard == 2 else 1.0) for s in light]
    for key in range(600):
        a, b = slow_place(key, light), slow_place(key, heavy)
        assert a == b or b // 4 == 0  # only the region of shard 2 gains rows
