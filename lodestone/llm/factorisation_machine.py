"""A factorisation machine over sparse rows, fitted by full gradients that Spark tasks sum, scored in time linear in a row's entries.

score(x) = sigmoid(bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pairwise sum is half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.
Weights are arrays of fixed size: one w and RANK factors for each feature number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import materialize

RANK = 4
#: Tasks that share the gradient of one update.
TRAINERS = 8


class Sparse:
    """Rows as one list of (feature, value) and the start of each row."""

    def __init__(self, features: np.ndarray, values: np.ndarray, starts: np.ndarray):
        self.features, self.values, self.starts = features, values, starts
        self.row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(features))))

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """Sums of entries by row; rows have one entry at least."""
        return np.add.reduceat(entries, self.starts, axis=0)


def first_weights(size: int, seed: int = 7) -> dict[str, np.ndarray]:
    factors = np.random.default_rng(seed).normal(0, 0.05, (size, RANK))
    return {"bias": np.zeros((1, 1), np.float32), "linear": np.zeros((size, 1), np.float32), "factors": factors.astype(np.float32)}


def margins(weights: dict[str, np.ndarray], rows: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """The log-odds of rows, and the sums of v_if x_i that gradients need too."""
    x = rows.values[:, None]
    own = weights["factors"][rows.features].astype(np.float64) * x
    both = rows.sums(np.concatenate([own, own**2, weights["linear"][rows.features] * x], axis=1))
    mixed, squares = both[:, :RANK], both[:, RANK : 2 * RANK]
    return weights["bias"][0, 0] + both[:, -1] + 0.5 * (mixed**2 - squares).sum(axis=1), mixed


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def gradient(weights: dict[str, np.ndarray], rows: Sparse, labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """The gradient of the log-loss summed over rows, and the loss."""
    z, mixed = margins(weights, rows)
    miss = sigmoid(z) - labels
    x = rows.values
    pull = miss[rows.row] * x
    linear = np.bincount(rows.features, weights=pull, minlength=len(weights["linear"]))[:, None]
    factors = np.empty(weights["factors"].shape)
    for f in range(RANK):
        own = weights["factors"][rows.features, f]
        factors[:, f] = np.bincount(rows.features, weights=pull * (mixed[rows.row, f] - own * x), minlength=len(factors))
    loss = float(np.logaddexp(0, np.where(labels > 0, -z, z)).sum())
    return {"bias": np.array([[miss.sum()]]), "linear": linear, "factors": factors}, loss


def packed(rows: DataFrame) -> DataFrame:
    """Rows (deal, label, features as bytes of 32-bit integers, values as bytes of 32-bit floats) put together for TRAINERS tasks, which take them by `deal`, a number that spreads equal rows too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features, values = (b.column(k).to_pylist() for k in (1, 2))
            lengths = np.array([len(f) // 4 for f in features], "<i4")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (b.column(0).to_numpy().astype("<f4").tobytes(), lengths.tobytes(), b"".join(features), b"".join(values))], names=["labels", "lengths", "features", "values"])

    dealt = rows.repartition(TRAINERS, "deal").sortWithinPartitions("deal", "features", "label")
    return dealt.select("label", "features", "values").mapInArrow(run, "labels binary, lengths binary, features binary, values binary")


def fit(rows: DataFrame, size: int, updates: int = 30, rate: float = 0.1, ridge: float = 0.0003) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights after so many updates by Adam's rule, and the mean loss before each. rows: (deal, label 0 or 1, features, values), see packed; each row's features are distinct numbers below size."""
    arrays = materialize(packed(rows), "machine")
    weights, losses = first_weights(size), []
    mean, square = ({k: np.zeros(w.shape) for k, w in weights.items()} for _ in range(2))
    for update in range(1, updates + 1):

        # The weights go with the task: under a megabyte, they leave no files behind as broadcasts to Python do.
        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total, loss, n = None, 0.0, 0
            for b in batches:
                for i in range(b.num_rows):
                    labels, lengths, features, values = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in enumerate(("<f4", "<i4", "<i4", "<f4")))
                    if not len(labels):
                        continue
                    starts = np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)
                    g, own = gradient(weights, Sparse(features.astype(np.int64), values.astype(np.float64), starts), labels.astype(np.float64))
                    total = g if total is None else {k: total[k] + g[k] for k in g}
                    loss, n = loss + own, n + len(labels)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), *(pa.array([total[k].astype("<f4").tobytes()], pa.binary()) for k in weights)], names=["loss", "n", *weights])

        got = arrays.mapInArrow(run, "loss double, n long, " + ", ".join(f"{k} binary" for k in weights)).toArrow()  # TRAINERS parts of one gradient, or a few more
        if not got.num_rows:
            break
        got = got.sort_by([("loss", "ascending"), ("n", "ascending")])  # sums don't depend on the order of tasks
        n = sum(got.column("n").to_pylist())
        losses.append(sum(got.column("loss").to_pylist()) / n)
        fresh = {}
        for k, w in weights.items():
            g = sum(np.frombuffer(x.as_buffer(), "<f4").astype(np.float64) for x in got.column(k)).reshape(w.shape) / n + ridge * w * (k != "bias")
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g**2
            fresh[k] = (w - rate * (mean[k] / (1 - 0.9**update)) / (np.sqrt(square[k] / (1 - 0.99**update)) + 1e-6)).astype(np.float32)
        weights = fresh
    return weights, losses
