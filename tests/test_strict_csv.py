"""The block-wise CSV reader against the csv module."""

import csv
import io
import random

import pytest

from matchloom.sources import files, strict_csv


def plain(text):
    """Rows of the csv module with their numbers, or None for a malformed text; empty lines have no number."""
    try:
        return list(enumerate(r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r))
    except csv.Error:
        return None


def random_texts(seed, n, alphabet):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def written(rnd):
    out = io.StringIO()
    rows = [[rnd.choice(["a", 'x"y', "p,q", "l\nm", "c\r\nd", "\r", "", "é" * 9, '""']) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 9))]
    csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"]), quoting=rnd.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL])).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("cut_at", [2, 7, 1 << 20])
def test_files_cut_anywhere_read_as_the_csv_module_reads_them(spark, tmp_path, cut_at):
    rnd = random.Random(5)
    texts = random_texts(1, 120, 'a,"\n') + random_texts(2, 120, 'ab,,""\r\n') + random_texts(3, 40, '"",\n') + [written(rnd) for _ in range(60)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut_at)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 12)
    try:
        rows = strict_csv.lines(spark, str(tmp_path))
        known = strict_csv.blocks(rows)
        name = lambda file: int(file.rsplit("/", 1)[1].removesuffix(".csv"))
        bad = {name(r.file) for r in known.filter("fault is not null").collect()}
        assert bad == {i for i, t in enumerate(texts) if plain(t) is None}
        assert cut_at > 16 or known.groupBy("file").count().agg({"count": "max"}).first()[0] > 1
        got = {}
        for r in strict_csv.records(rows, known).collect():
            got.setdefault(name(r.file), []).append((r.number, r["values"]))
        for i, text in enumerate(texts):
            if i not in bad:
                assert sorted(got.get(i, [])) == plain(text), (i, text)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_rows_take_no_deep_recursion(spark, tmp_path):
    (tmp_path / "a.csv").write_text("full_name\n" + '"' + 'x""' * 300_000 + '"\n' + ",".join(['"a"'] * 200_000) + "\n")
    rows = files.candidate_csv(spark, str(tmp_path / "a.csv")).orderBy("row_number").collect()
    assert [(len(r.full_name), r.extra_values) for r in rows] == [(600_000, False), (1, True)]


@pytest.mark.parametrize("text", [b'full_name\n"Ann\n', b'full_name\n"Ann"x\n', b"full_name\nA\0\n", b"full_name\n\xff\n", b'"full_name\n'])
def test_invalid_files_are_rejected(spark, tmp_path, text):
    (tmp_path / "a.csv").write_bytes(text)
    with pytest.raises(ValueError, match="not valid"):
        files.candidate_csv(spark, str(tmp_path / "a.csv"))


def test_marks_empty_files_and_rows_of_values_beyond_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿"full_name","location"\r\n\r\n"A ""B""","x\r\ny"\r\n,,z\n'.encode())
    rows = files.candidate_csv(spark, str(tmp_path / "a.csv")).orderBy("row_number").collect()
    assert [(r.row_number, r.full_name, r.location, r.extra_values) for r in rows] == [(2, 'A "B"', "x\r\ny", False), (3, "", "", True)]
    (tmp_path / "e.csv").write_bytes(b"")
    with pytest.raises(ValueError, match="empty"):
        files.candidate_csv(spark, str(tmp_path / "e.csv"))
