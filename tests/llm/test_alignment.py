"""op11: token pairs, groups and counts against a plain alignment of whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from matchloom.llm import tokenizer_alignment as A
from matchloom.llm.perfect_hash import PerfectHash, build


def plain(texts):
    """Rows of each text by the definition: whole texts, spans by bytes, every overlap."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    symbol = {c: b for b, c in enumerate(A.byte_symbols())}
    links, out = [], []
    for text in texts:
        own, groups, a, b = [], [], [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
            a_bytes = [bytes(symbol[c] for c in t.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a, b = [], []
            else:
                ea, eb = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
                for i, x in enumerate(a):
                    for j, y in enumerate(b):
                        if max(([0] + ea)[i], ([0] + eb)[j]) < min(ea[i], eb[j]):
                            own.append((x, y))
                last_a = last_b = 0
                for end in sorted(set(ea) & set(eb)):
                    i, j = ea.index(end) + 1, eb.index(end) + 1
                    groups.append(",".join(map(str, a[last_a:i])) + "|" + ",".join(map(str, b[last_b:j])))
                    last_a, last_b = i, j
        links.append(own)
        out.append([len(a), len(b), len(groups), len(own), ";".join(groups)])
    count = Counter(p for own in links for p in own)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(*row[:4], sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), row[4]) for row, own in zip(out, links, strict=True)]


def texts(n=300):
    rnd = random.Random(4)
    pool = ["a", "the ", "naïve ", "中文", "🎉👩‍👩", " ", "  ", "\t", "\n", "\n ", "\x85", " ", "　 ", "\xa0", "\x1c", "\x1f ", "\x00", "'s", " don't", "▁", "<|endoftext|>", "</s>", "<0x41>", "1234", " 5", "é", "é ", "x.y ", "-", "ing "]
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25))) for _ in range(n)]
    return [*out, None, "", " ", "  ", "a ", " a", "ha " * 300, "x" * 4000, *out[:20]]


def test_chunks_give_the_text_back():
    for t in texts():
        if t:
            assert " ".join(A.chunks(t)) == t and all(A.chunks(t)[1:])


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 30_000):
        keys = rnd.choice(1 << 40, n, replace=False).astype(np.uint64)
        h = PerfectHash(build(keys))
        assert h.size == n and sorted(h.slots(keys).tolist()) == list(range(n))
        assert len(build(keys)) < 100 + n
    with pytest.raises(ValueError):
        build(np.zeros(2, np.uint64))


@pytest.mark.parametrize(("head", "shard"), [(A.HEAD, A.SHARD), (40, 16), (0, 50)])
def test_frames(spark, head, shard):
    held = texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(held)], "doc_id long, text string, Groups string").repartition(3)
    got = A.align(df, head=head, shard=shard).collect()
    want = Counter((i if i % 7 else None, *row) for i, row in enumerate(plain(held)))
    assert Counter(tuple(r) for r in got) == want
    assert A.align(df.limit(0), head=head).count() == 0


def test_many_tasks_are_summed_along_a_tree(spark):
    held = texts(60)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(held)], "doc_id string, text string").repartition(40)
    assert Counter(tuple(r) for r in A.align(df, shard=100).collect()) == Counter((str(i), *row) for i, row in enumerate(plain(held)))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: row for d, row in zip(docs, plain([d.text for d in docs]), strict=True)} if sum(len(d.text or "") for d in docs) < 3_000_000 else {}
    for r in A.op11_alignment(spark, sf).collect():
        *numbers, groups = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
