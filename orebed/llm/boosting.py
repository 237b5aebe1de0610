"""Boosted trees of depth two over small integer features, from histograms that tasks add up.

Sums are whole numbers of ``1 / SCALE``, so that they are the same however rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64
SCALE = 1 << 24


def _best_split(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, threshold) by sums for each feature and value: rows with a value up to
    the threshold go left."""
    best = (1e-6, -1, 0)
    whole = gradient[0].sum() ** 2 / (weight[0].sum() + 1)
    for feature in range(len(gradient)):
        g, w = np.cumsum(gradient[feature]), np.cumsum(weight[feature])
        gain = g**2 / (w + 1) + (g[-1] - g) ** 2 / (w[-1] - w + 1) - whole
        at = int(gain[:-1].argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), feature, at)
    return best


@dataclass
class Boosted:
    """Sum of trees; each is (feature, threshold) at the root and at both children, and four
    values. A feature of -1 sends all rows left."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for splits, values in self.trees:
            total += values[_leaf(x, splits)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _leaf(x: np.ndarray, splits: np.ndarray) -> np.ndarray:
    rows = np.arange(len(x))
    right = (splits[0, 0] >= 0) & (x[rows, splits[0, 0]] > splits[0, 1])
    child = np.where(right, 2, 1)
    feature, threshold = splits[child, 0], splits[child, 1]
    return 2 * right + ((feature >= 0) & (x[rows, feature] > threshold))


def histograms(
    model: Boosted, splits: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray
) -> np.ndarray:
    """Gradients (0) and weights (1) by side of the root, feature and value, of rows that occur
    ``n`` times."""
    chance = model.probability(x)
    side = ((splits[0, 0] >= 0) & (x[:, splits[0, 0]] > splits[0, 1])).astype(np.int64)
    total = np.zeros((2, 2, x.shape[1], BINS), dtype=np.int64)
    for part, values in enumerate((y - chance, chance * (1 - chance))):
        scaled = np.rint(values * SCALE) * n
        for feature in range(x.shape[1]):
            cells = np.bincount(side * BINS + x[:, feature], scaled, 2 * BINS)
            total[part, :, feature] = cells.reshape(2, BINS)
    return total


def grow(
    sums: Callable[[Boosted, np.ndarray], np.ndarray], share: float, *, trees: int = 60,
    rate: float = 0.3,
) -> Boosted:
    """Logistic boosting by second-order steps. ``sums`` adds up ``histograms`` of all rows, of
    which ``share`` have label 1."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    for _ in range(trees):
        splits, values = np.full((3, 2), -1), np.zeros(4)
        gradient, weight = sums(model, splits).sum(axis=1) / SCALE
        _, splits[0, 0], splits[0, 1] = _best_split(gradient, weight)
        gradients, weights = sums(model, splits) / SCALE
        for child, (gradient, weight) in enumerate(zip(gradients, weights), 1):
            _, feature, threshold = _best_split(gradient, weight)
            splits[child] = feature, threshold
            cut = threshold + 1 if feature >= 0 else BINS
            for leaf, part in enumerate((slice(0, cut), slice(cut, BINS))):
                g, w = gradient[feature, part].sum(), weight[feature, part].sum()
                values[2 * child - 2 + leaf] = rate * g / (w + 1)
        model.trees.append((splits, values))
    return model


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Trees from rows at hand. ``x`` holds integers from 0 to ``BINS - 1``."""
    once = np.ones(len(x), dtype=np.int64)
    return grow(lambda model, splits: histograms(model, splits, x, y, once), float(y.mean()))


def unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """The features of rows, a byte each."""
    return np.array([list(row) for row in batch.column("values").to_pylist()], dtype=np.int64)


def fit_table(rows: DataFrame, features: int, share: float) -> Boosted:
    """Trees from all rows of a stored table: values (a byte a feature), label and n, how often
    such a row occurs. Tasks read it twice a tree and return bounded sums."""

    def sums(model: Boosted, splits: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 * features * BINS, dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    y, n = batch.column("label").to_numpy(), batch.column("n").to_numpy()
                    total += histograms(model, splits, unpacked(batch), y, n).ravel()
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"]
            )

        cells = rows.select("values", "label", "n").mapInArrow(add, "cell int, n bigint")
        found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(4 * features * BINS, dtype=np.int64)
        total[found["cell"].to_numpy()] = found["n"].to_numpy()
        return total.reshape(2, 2, features, BINS)

    return grow(sums, share)
