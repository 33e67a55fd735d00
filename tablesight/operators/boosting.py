"""Gradient boosting for several classes at once (softmax loss).

One tree per class and round, all classes grown together: a level of all trees is one pass
over the rows that gives, per class, node, feature and bin, the sums of the residuals, of
p (1 - p) and of the rows; these histograms are added by one grouped aggregate, and the
driver picks the splits (its input is bounded by classes, nodes, features and bins).
Rows keep their class scores, written anew every ``STORE`` rounds to the shared checkpoint
folder, so a pass evaluates few trees and no lineage grows.

Splits take the greatest improvement n_l n_r / (n_l + n_r) (mean_l - mean_r)^2 of the
residuals (first feature and bin on ties); a leaf adds (K - 1) / K * sum r / sum p (1 - p)
times the learning rate. Scores start at the logarithms of the classes' shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import ensure_checkpoint_dir

#: Rounds between two writings of the rows' scores.
STORE = 10
#: Histogram entries of a pass that may go to the driver.
MOST_VALUES = 50_000_000
_TINY = 1e-12


class Tree(NamedTuple):
    """A full binary tree: node i has the children 2i + 1 and 2i + 2; rows whose bin is at
    most ``edge`` go left."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.edge[at])
        return at

    def add(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.value[self.node(bins, depth) - (2 ** depth - 1)]


def to_bins(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """How many borders of its feature a value is above."""
    return np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(borders)], 1).astype(np.uint8)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class SoftmaxBoosting(Estimator):
    """Estimator over a vector column ``features`` and class numbers ``label``."""

    def __init__(self, rounds: int = 100, depth: int = 3, rate: float = 0.1, bins: int = 64, features: str = "features", label: str = "label"):
        super().__init__()
        if not 2 <= bins <= 256:
            raise ValueError("bins has to be 2 to 256")
        self.rounds, self.depth, self.rate, self.bins, self.features, self.label = rounds, depth, rate, bins, features, label

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        spark, rate, depth = dataset.sparkSession, self.rate, self.depth
        rows = dataset.select(vector_to_array(col(self.features)).alias("x"), col(self.label).cast("int").alias("y")).filter("y is not null")
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one row per class
        if not counts:
            raise ValueError("no rows with a label")
        k, n = max(counts) + 1, sum(counts.values())
        d = rows.select(F.size("x")).first()[0]
        if k * 2 ** (depth - 1) * d * self.bins * 3 > MOST_VALUES:
            raise ValueError("too many histogram entries for the driver")
        start = np.log(np.maximum(np.array([counts.get(c, 0) for c in range(k)]), _TINY) / n)
        probs = [i / self.bins for i in range(1, self.bins)]
        found = rows.agg(*[F.percentile_approx(F.col("x")[j], probs, 100 * self.bins).alias(f"b{j}") for j in range(d)]).first()
        borders = [np.unique(np.array(found[f"b{j}"], float)) for j in range(d)]
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"

        def first(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                if len(pdf):
                    bins = to_bins(np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1), borders)
                    yield pd.DataFrame({"b": [b.tobytes() for b in bins], "y": pdf["y"], "s": [start.tolist()] * len(pdf)})

        kind = "b binary, y int, s array<double>"
        rows.mapInPandas(first, kind).write.parquet(f"{base}/0")
        state = spark.read.parquet(f"{base}/0")
        trees: list[list[Tree]] = []
        recent: list[list[Tree]] = []  # not yet in the stored scores
        gains = np.zeros(d)
        for r in range(self.rounds):
            grown = [Tree(np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, 255), np.zeros(2 ** depth)) for _ in range(k)]
            for level in range(depth):
                self._grow(state, recent, grown, level, k, d, gains)
            trees.append(grown)
            recent.append(grown)
            if len(recent) == STORE and r + 1 < self.rounds:
                done = list(recent)

                def renew(it: Iterator[pd.DataFrame], done=done) -> Iterator[pd.DataFrame]:
                    for pdf in it:
                        if len(pdf):
                            bins, s = _unpack(pdf, d, k)
                            yield pd.DataFrame({"b": pdf["b"], "y": pdf["y"], "s": list(_scores(bins, s, done, depth, rate))})

                state.mapInPandas(renew, kind).write.parquet(f"{base}/{r + 1}")
                state = spark.read.parquet(f"{base}/{r + 1}")
                recent = []
        return SoftmaxBoostingModel(borders, start, trees, depth, rate, gains / (gains.sum() or 1.0), self.features)

    def _grow(self, state: DataFrame, recent: list[list[Tree]], grown: list[Tree], level: int, k: int, d: int, gains: np.ndarray) -> None:
        """One level of all trees: split the nodes, and on the last level set the leaves."""
        depth, rate, bins = self.depth, self.rate, self.bins
        nodes, before = 2 ** level, 2 ** level - 1

        def histograms(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((k, 3, d, nodes * bins))
            some = False
            for pdf in it:
                if not len(pdf):
                    continue
                some = True
                b, s = _unpack(pdf, d, k)
                p = softmax(_scores(b, s, recent, depth, rate))
                y = pdf["y"].to_numpy(np.int64)
                for c in range(k):
                    node = (grown[c].node(b, level) - before) * bins
                    residual, weight = (y == c) - p[:, c], p[:, c] * (1 - p[:, c])
                    for j in range(d):
                        at = node + b[:, j]
                        for m, w in enumerate((residual, weight, None)):
                            out[c, m, j] += np.bincount(at, w, nodes * bins)
            if some:
                yield pd.DataFrame({"c": range(k), "h": [h.ravel() for h in out]})

        sums = state.mapInPandas(histograms, "c int, h array<double>").groupBy("c").agg(
            vector_to_array(Summarizer.sum(array_to_vector("h"))).alias("h")).collect()  # one row per class
        for r in sums:
            tree, h = grown[r["c"]], np.array(r["h"]).reshape(3, d, nodes, bins)
            for node in range(nodes):
                left = h[:, :, node].cumsum(2)  # sums of the rows that go left at each bin
                total = left[:, 0, -1]
                right = total[:, None, None] - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = left[2] * right[2] / total[2] * (left[0] / left[2] - right[0] / right[2]) ** 2
                gain = np.where((left[2] > 0) & (right[2] > 0), gain, 0.0)
                # equal up to rounding counts as equal, whatever order the sums came in
                best = int(np.nonzero(gain.ravel() >= gain.max() * (1 - 1e-9))[0][0])
                j, edge = divmod(best, bins)
                if gain[j, edge] <= _TINY:
                    j, edge = 0, bins - 1  # all rows stay left
                else:
                    gains[j] += gain[j, edge]
                tree.feature[before + node], tree.edge[before + node] = j, edge
                if level == depth - 1:
                    for side, part in enumerate((left[:, j, edge], right[:, j, edge])):
                        tree.value[2 * node + side] = (k - 1) / k * part[0] / part[1] if part[1] > _TINY else 0.0


def _unpack(pdf: pd.DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(pdf), d), np.array(pdf["s"].tolist(), float).reshape(len(pdf), k))


def _scores(bins: np.ndarray, s: np.ndarray, rounds: list[list[Tree]], depth: int, rate: float) -> np.ndarray:
    s = s.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            s[:, c] += rate * tree.add(bins, depth)
    return s


class SoftmaxBoostingModel(Model):
    """Adds ``probability`` (a vector, one entry per class) and ``prediction``."""

    def __init__(self, borders, start, trees, depth, rate, importances, features):
        super().__init__()
        self.borders, self.start, self.trees, self.depth, self.rate, self.features = borders, start, trees, depth, rate, features
        self.featureImportances = DenseVector(importances)
        self.numClasses = len(start)

    def predict_probability(self, x: np.ndarray) -> np.ndarray:
        s = np.tile(self.start, (len(x), 1))
        return softmax(_scores(to_bins(x, self.borders), s, self.trees, self.depth, self.rate))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                x = np.array(s.tolist(), float).reshape(len(s), -1)
                yield pd.Series(list(model.predict_probability(x))) if len(s) else pd.Series([], dtype=object)

        p = F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)(vector_to_array(col(self.features)))
        out = dataset.withColumn("__p", p)
        return out.withColumn("probability", array_to_vector("__p")).withColumn(
            "prediction", (F.array_position("__p", F.array_max("__p")) - 1).cast("double")).drop("__p")
