"""op5: answers for copies of one text spread over groups; slices that decide for themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import substring_dedup as R

from test_texts import slow_repeats


def test_copies_spread_over_groups():
    n, groups = 400, 8
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [" ".join(f"w{i}" for i in range(20))] * n})
    packed = pa.Table.from_batches(R._packer(13, 1)(iter([docs])))
    sizes = [len(np.frombuffer(x, np.int64)) for x in R._judge(groups)(packed).column("ids").to_pylist()]
    assert sum(sizes) == n - 1 and len(sizes) == groups and max(sizes) < 2 * n / groups


@pytest.mark.parametrize(("parts", "bucket"), [(1, 1 << 22), (9, 1 << 22), (9, 30), (40, 30)])
def test_hot_windows_over_many_slices(spark, parts, bucket):
    """One passage in most documents, one word repeated, copies and repeated rows, in one slice or in many."""
    rnd = random.Random(5)
    hot = " ".join(f"h{i}" for i in range(20))
    rows = []
    for d in range(150):
        own = " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 20)))
        rows.append((rnd.randint(0, 100), rnd.choice([own, f"{own} {hot}", f"{hot} {own} {hot}", "und " * rnd.randint(10, 60) + own, hot])))
    rows += [rows[3]] * 4 + [(None, hot), (None, hot), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = R.remove_repeats(df, bucket_windows=bucket).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == slow_repeats(rows)


def test_a_hot_window_leaves_a_slice_once():
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": [" ".join(f"w{i}" for i in range(13))] * 500})
    packed = pa.Table.from_batches(R._packer(13, 4)(iter([docs]))).to_pylist()
    assert sum(len(r["hashes"] or b"") for r in packed) == 8
