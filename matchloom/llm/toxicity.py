"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

One weight vector is shared by all ordered thresholds: P(grade <= j) is the
logistic of theta_j - w.x.  The output is the expected grade and the probability
of any toxicity.  ``labels.toxic`` only tells toxic from clean, so fitting first
grades the toxic rows by dose: words that the training rows mark as toxic are
found by a log-odds test, and toxic rows are parted at the quantiles of the
share that such words have of their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .features import Sparse, hashed_words, join_rows, labelled_sample, row_sums
from .stage import ensure
from .textkit import Words, text_slices

BUCKETS = 1 << 18
GRADES = 4
#: Labelled rows that a model is fitted on at most.
TRAIN_ROWS = 20_000
#: P(grade > 0) from which a text counts as toxic; toxic rows are few, so one half would miss many.
THRESHOLD = 0.25

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[np.frombuffer(b".,;:!?\"'()[]*#%&$|<>", np.uint8)] = 0x20


class Model(NamedTuple):
    thetas: np.ndarray  # (GRADES - 1), ascending
    weight: np.ndarray  # (BUCKETS), float32


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_counts(texts: pa.Array) -> Sparse:
    """Lower-cased words without punctuation, hashed and counted by text."""
    words = Words(texts, _FOLD)
    return hashed_words(words, words.hashes(), BUCKETS)


def _values(sparse: Sparse) -> np.ndarray:
    """Damped counts, scaled down in long texts so that many small weights don't outweigh a few strong words."""
    n = row_sums(sparse.times, sparse.first)
    return (1 + np.log(sparse.times)) * np.repeat((n / 100 + 1) ** -0.5, np.diff(sparse.first))


def log_odds(toxic: np.ndarray, sparse: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket the z-score of its smoothed log-odds of standing in toxic rows, and the rows that hold it."""
    row = np.repeat(np.arange(len(toxic)), np.diff(sparse.first))
    hit = np.bincount(sparse.ids, toxic[row], BUCKETS)
    miss = np.bincount(sparse.ids, 1 - toxic[row], BUCKETS)
    t, c = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    z = (np.log((hit + 0.5) / (t + 1)) - np.log((miss + 0.5) / (c + 1))) / np.sqrt(1 / (hit + 0.5) + 1 / (miss + 0.5))
    return z, hit + miss


def grades(toxic: np.ndarray, sparse: Sparse, z: np.ndarray, least_z: float = 3.0) -> np.ndarray:
    """0 for clean rows, 1 to GRADES - 1 for toxic ones by the share of their words that are marked as toxic."""
    dose = row_sums(sparse.times * (z > least_z)[sparse.ids], sparse.first) / np.maximum(row_sums(sparse.times, sparse.first), 1)
    some = dose[toxic > 0]
    out = np.zeros(len(toxic), np.int64)
    if len(some):
        out[toxic > 0] = 1 + np.searchsorted(np.quantile(some, np.arange(1, GRADES - 1) / (GRADES - 1)), some, "left")
    return out


def loss_and_gradient(par: np.ndarray, size: int, where: np.ndarray, x: np.ndarray, first: np.ndarray, grade: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of grades with decay of the weights, and its gradient.

    ``par`` is ``size`` weights, the first threshold, and the logarithms of the gaps to the next ones;
    entries (where, x) of row i are those from first[i] on.
    """
    w, gap, n = par[:size], par[size:], len(grade)
    row = np.repeat(np.arange(n), np.diff(first))
    thetas = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
    s = row_sums(w[where] * x, first)
    cut = np.concatenate([[-np.inf], thetas, [np.inf]])
    up, low = _sigmoid(cut[grade + 1] - s), np.where(grade > 0, _sigmoid(cut[grade] - s), 0.0)
    p = np.maximum(up - low, 1e-9)
    du, dl = up * (1 - up) / p, low * (1 - low) / p
    gs = (du - dl) / n  # of the loss by s
    gt = np.bincount(grade, -du / n, GRADES)[: GRADES - 1] + np.bincount(grade, dl / n, GRADES)[1:]
    tail = np.cumsum(gt[::-1])[::-1]
    grad = np.concatenate([np.bincount(where, gs[row] * x, size) + decay * w, tail[:1], tail[1:] * np.exp(gap[1:])])
    return float(-np.log(p).mean() + decay / 2 * (w**2).sum()), grad


def fit(data: dict[str, list], rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, least_z: float = 2.5, least: int = 4) -> Model:
    """Full-batch Adam on the cumulative-link likelihood.  No rows, or no toxic ones: severity near zero.

    Only buckets that stand in ``least`` rows and tell the classes apart by a
    z-score of ``least_z`` get a weight, so that rare words aren't learnt by heart.
    """
    y = np.array(data["label"], float)
    thetas = np.array([3.0, 4.0, 5.0])[: GRADES - 1]
    if not len(y) or not y.any():
        return Model(np.full(GRADES - 1, 30.0), np.zeros(BUCKETS, np.float32))
    first, ids = join_rows(data["ids"])
    sparse = Sparse(first, ids, join_rows(data["times"])[1])
    z, rows = log_odds(y, sparse)
    grade = grades(y, sparse, z)
    told = ((np.abs(z) >= least_z) & (rows >= least))[ids]
    full, first = first, np.concatenate([[0], np.cumsum(told)])[first]
    x = _values(Sparse(full, ids, sparse.times))[told]
    used, where = np.unique(ids[told], return_inverse=True)
    gap = np.log(np.diff(thetas, prepend=thetas[0] - 1))
    gap[0] = thetas[0]  # thetas are the first one and exponentials of gaps, so they stay in order
    par, m, v = np.concatenate([np.zeros(len(used)), gap]), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, grad = loss_and_gradient(par, len(used), where, x, first, grade, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        par = par - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = par[: len(used)]
    gap = par[len(used) :]
    return Model(np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])])), weight)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model of labels.toxic, fitted on at most ``most`` rows outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "toxic", (), BUCKETS, most, word_counts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic, grade (likeliest), toxic (p_toxic at least THRESHOLD).

    One row for each row, whole texts, null and empty ones as texts without
    words.  Columns besides doc_id and text are ignored.
    """
    docs = ensure(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                sparse = word_counts(part.column("text"))
                s = row_sums(model.weight[sparse.ids] * _values(sparse), sparse.first)
                above = 1 - _sigmoid(model.thetas[None, :] - s[:, None])  # P(grade > j)
                p = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(p.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= THRESHOLD),
                ], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, severity double, p_toxic double, grade int, toxic boolean")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
