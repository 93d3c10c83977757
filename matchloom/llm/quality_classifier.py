"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have rank ``FACTORS``; a score takes time linear in the
features present, by sum over factors of half (sum v x)^2 - sum v^2 x^2.
Statistics and metadata are cut into bins at quantiles of the training rows, so
that bins can interact with each other and with words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .features import Sparse, hashed_words, held_out, join_rows, labelled_sample, meta_columns, row_sums, statistics
from .stage import by_position
from .textkit import Words, text_slices

BUCKETS = 1 << 12
FACTORS = 8
BINS = 16
#: Labelled rows that a model is fitted on at most.
TRAIN_ROWS = 12_000
THRESHOLD = 0.3
METADATA = ("n_chars",)


class Model(NamedTuple):
    cuts: np.ndarray  # (statistics and metadata, BINS - 1)
    bias: float
    weight: np.ndarray  # (BUCKETS + bins)
    factor: np.ndarray  # (BUCKETS + bins, FACTORS)


def _binned(cuts: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Feature numbers of the bins of each row's statistics, beyond those of the words."""
    bins = np.stack([np.searchsorted(c, stats[:, i], "right") for i, c in enumerate(cuts)], 1)
    return BUCKETS + np.arange(len(cuts)) * BINS + bins


def _rows(sparse: Sparse, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges, feature numbers and values: words with a norm of one, then a one for each bin."""
    n, k = bins.shape
    norm = np.sqrt(row_sums(sparse.times.astype(np.float64) ** 2, sparse.first))
    x = sparse.times / np.repeat(np.maximum(norm, 1e-9), np.diff(sparse.first))
    first = sparse.first + k * np.arange(n + 1)
    ids, val = np.empty(first[-1], np.int64), np.ones(first[-1], np.float64)
    word = np.arange(len(sparse.ids)) + k * np.repeat(np.arange(n), np.diff(sparse.first))
    ids[word], val[word] = sparse.ids, x
    ids[(first[1:, None] - k + np.arange(k)).ravel()] = bins.ravel()
    return first, ids, val


def margins(model: Model, first: np.ndarray, ids: np.ndarray, val: np.ndarray) -> np.ndarray:
    vx = model.factor[ids] * val[:, None]
    return model.bias + row_sums(model.weight[ids] * val, first) + 0.5 * (row_sums(vx, first) ** 2 - row_sums(vx**2, first)).sum(1)


def fit(data: dict[str, list], epochs: int = 8, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Model:
    """Adam on the logistic loss.  No rows: a score of one half; a single class: close to that class."""
    rng = np.random.default_rng(seed)
    n, kinds = len(data["label"]), len(data["stats"][0]) if data["stats"] else 0
    size = BUCKETS + kinds * BINS
    if not n:
        return Model(np.zeros((0, BINS - 1)), 0.0, np.zeros(size), np.zeros((size, FACTORS)))
    y = np.array(data["label"], float)
    stats = np.stack(data["stats"])
    cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    starts, words = join_rows(data["ids"])
    first, ids, val = _rows(Sparse(starts, words, join_rows(data["times"])[1]), _binned(cuts, stats))
    share = np.clip(y.mean(), 0.01, 0.99)
    theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, FACTORS))], 1)
    bias, m, v, mb, vb, t = float(np.log(share / (1 - share))), np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            length = first[rows + 1] - first[rows]
            edge = np.concatenate([[0], np.cumsum(length)])
            take = np.arange(edge[-1]) + np.repeat(first[rows] - edge[:-1], length)
            i, x = ids[take], val[take]
            vx = theta[i, 1:] * x[:, None]
            s = row_sums(vx, edge)
            z = bias + row_sums(theta[i, 0] * x, edge) + 0.5 * (s**2 - row_sums(vx**2, edge)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            gx = np.repeat(g, length) * x
            inner = np.repeat(s, length, axis=0) - vx
            grad = np.stack([np.bincount(i, gx, size), *[np.bincount(i, gx * inner[:, f], size) for f in range(FACTORS)]], 1) + decay * theta
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            gb = g.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(cuts, bias, theta[:, 0].copy(), theta[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, metadata: tuple[str, ...] = METADATA) -> Model:
    """A model of labels.quality, fitted on at most ``most`` rows outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "quality", metadata, BUCKETS, most))


def score(docs: DataFrame, model: Model, metadata: tuple[str, ...] = METADATA, reject_below: float | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on) in place of any columns of these names.

    One row for each row, whole texts, null as empty; only text and ``metadata``
    are read.  With ``reject_below`` rows that score less are dropped and the
    columns of docs alone are returned.
    """
    docs, restored = by_position(docs, "text", *metadata)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                if len(model.cuts):
                    stats = np.concatenate([statistics(words, hashes), meta_columns(part, metadata)], 1)
                    bins = _binned(model.cuts, stats)
                else:
                    bins = np.zeros((part.num_rows, 0), np.int64)
                z = margins(model, *_rows(hashed_words(words, hashes, BUCKETS), bins))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                if reject_below is not None:
                    yield part.filter(pa.array(p >= reject_below))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*part.schema.names, "_score_", "_predicted_"])

    if reject_below is not None:
        return restored(docs.mapInArrow(run, docs.schema))
    scored = docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_score_", DoubleType()).add("_predicted_", IntegerType()))
    # columns go by position, since names may clash
    names = restored(docs).columns
    kept = [(i, n) for i, n in enumerate(names) if n.lower() not in ("score", "predicted")]
    return scored.select(*[docs.columns[i] for i, _ in kept], "_score_", "_predicted_").toDF(*[n for _, n in kept], "score", "predicted")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text", *METADATA), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
