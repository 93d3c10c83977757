"""Very long texts of one repeated unit: time grows with the text."""

import random
import time

import pytest

from matchloom.llm import secrets as S

UNITS = ["a.", "a-", "9.", "ha ", "auth ", "auth", "user", "user ", "password ", "password:", "x://", "a.b:80 ", "a-a.", "-", ".", ":80", "1.1.1.1:", "AKIA", "secret=\"", "\n \n", "\n\t", "token  ", "A1b", "=", "bearer=", "ab.cd:8080", "  "]


@pytest.mark.parametrize("unit", UNITS)
def test_a_megabyte_of_one_unit(unit):
    for head in ("", "password=abcdef1 ", "auth "):
        text = head + unit * (1_000_000 // len(unit)) + " Zq3" * 5 + "Zq3xZq3xZq3xZq3xZq3xZq3x"
        began = time.process_time()
        S.masked(text)
        assert time.process_time() - began < 4, (head, unit)


def test_endpoints_equal_the_plain_pattern():
    plain = S._ENDPOINT
    rnd = random.Random(6)
    for _ in range(4000):
        text = "".join(rnd.choice(["a", "bc", ".", "-", ":80", ":8080 ", " ", "X", "_", "1", "10.0.0.1", "db.host", "http://", "\n", "é"]) for _ in range(rnd.randint(1, 14)))
        assert [p[1:3] for p in S.endpoints(text)] == [m.span() for m in plain.finditer(text)], text


def test_repetitive_texts_make_few_matches():
    import resource

    from matchloom.llm import decontamination as D

    for unit, item in ((["ha"], ["ha"] * 1000), (["a", "b"], ["a", "b"] * 400)):
        text = " ".join(unit * (200_000 // len(unit)))
        began, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        got = matches(D, [text], [" ".join(item)])
        assert [g[:2] for g in got] == [(0, 0)]
        assert time.process_time() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def matches(D, texts, items):
    """The index of some items by hand, and what the texts match."""
    import numpy as np
    import pyarrow as pa

    words, h, owner, place = D.seeds(pa.array(items), 5, (1, 2, 3, 4), True)
    lengths = words.counts()
    before, after = D.beside(words, owner, place, 5, D._NO_WORD[1])
    long = lengths[owner] >= 5
    order = np.argsort(h[~long], kind="stable")
    found = D.Index(D.edges(h[long], owner[long], place[long], before[long]), D.edges(h[long], owner[long], place[long], after[long]), h[~long][order], owner[~long][order], list(range(len(items))), lengths)
    return list(D._matches(found, pa.array(texts), 5, 0.5))


def test_tiles_equal_those_of_all_pairs():
    from matchloom.llm import decontamination as D

    rnd = random.Random(11)
    for _ in range(150):
        kinds = rnd.choice([1, 2, 3, 20])
        make = lambda n: [f"w{rnd.randrange(kinds)}" for _ in range(n)]
        items = [make(rnd.randint(1, 30)) for _ in range(3)]
        texts = [make(rnd.randint(0, 40)) + rnd.choice(items) * rnd.randint(0, 2) + make(rnd.randint(0, 9)) for _ in range(3)]
        got = {(r, i): sorted(t) for r, i, t in matches(D, [" ".join(t) for t in texts], [" ".join(i) for i in items])}
        want = {}
        for r, t in enumerate(texts):
            for i, item in enumerate(items):
                if len(item) < 5:
                    at = [d for d in range(len(t) - len(item) + 1) if t[d : d + len(item)] == item]
                    if at:
                        want[r, i] = [(at[0], 0, len(item))]
                    continue
                pairs = [(d, q) for d in range(len(t) - 4) for q in range(len(item) - 4) if t[d : d + 5] == item[q : q + 5]]
                if pairs:
                    import numpy as np

                    tiles = D.tile(*map(np.array, zip(*pairs, strict=True)))
                    if sum(x[2] for x in tiles) >= 0.5 * len(item):
                        want[r, i] = sorted(tiles)
        assert got == want
