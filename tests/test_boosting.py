"""Softmax boosting against a plain loop over all rows, classes and thresholds."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablesight.operators import boosting as B


def brute(x, y, rounds, depth, rate):
    """Exact greedy trees on all thresholds; returns the class probabilities of the rows."""
    k = y.max() + 1
    s = np.tile(np.log(np.bincount(y) / len(y)), (len(y), 1))

    def tree(rows, r, h, left):
        if left and len(rows) > 1:
            found = []
            for j in range(x.shape[1]):
                for t in np.unique(x[rows, j])[:-1]:
                    a, b = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    found.append((len(a) * len(b) / len(rows) * (r[a].mean() - r[b].mean()) ** 2, a, b))
            if found and max(f[0] for f in found) > 1e-12:
                best = max(f[0] for f in found)
                _, a, b = next(f for f in found if f[0] >= best * (1 - 1e-9))
                return tree(a, r, h, left - 1) + tree(b, r, h, left - 1)
        return [(rows, (k - 1) / k * r[rows].sum() / h[rows].sum())]

    for _ in range(rounds):
        p, new = B.softmax(s), s.copy()
        for c in range(k):
            for rows, value in tree(np.arange(len(y)), (y == c) - p[:, c], p[:, c] * (1 - p[:, c]), depth):
                new[rows, c] += rate * value
        s = new
    return B.softmax(s)


def rows_of(n=240, seed=2):
    rnd = np.random.default_rng(seed)
    x = np.stack([rnd.integers(0, 15, n), rnd.integers(0, 5, n), rnd.integers(0, 2, n), np.ones(n)], 1).astype(float)
    y = ((x[:, 0] > 6).astype(int) + ((x[:, 0] > 10) & (x[:, 1] > 1)) + (rnd.random(n) < 0.1)) % 3
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "key long, x array<double>, label int").repartition(
        3).withColumn("features", array_to_vector("x"))


def test_probabilities_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "STORE", 2)  # scores are written and read back in between
    x, y = rows_of()
    df = frame(spark, x, y)
    model = B.SoftmaxBoosting(rounds=5, depth=3, rate=0.3, bins=64).fit(df)
    got = model.transform(df).select("key", vector_to_array("probability").alias("p"), "prediction").orderBy("key").toPandas()
    p = np.array(got["p"].tolist())
    assert np.allclose(p.sum(1), 1.0)
    assert np.allclose(p, brute(x, y, 5, 3, 0.3), atol=1e-9)
    assert (got["prediction"].to_numpy() == p.argmax(1)).all()
    assert model.featureImportances.toArray().argmax() == 0 and model.featureImportances.toArray()[3] == 0


def test_learns_and_handles_odd_tables(spark):
    x, y = rows_of(400, 5)
    df = frame(spark, x, y)
    pred = B.SoftmaxBoosting(rounds=8, rate=0.5).fit(df).transform(df)
    assert pred.filter("prediction = label").count() > 0.8 * 400
    one = frame(spark, x[:20], np.zeros(20, int))
    assert B.SoftmaxBoosting(rounds=2).fit(one).transform(one).filter("prediction = 0").count() == 20
    with pytest.raises(ValueError):
        B.SoftmaxBoosting(rounds=2).fit(df.limit(0))
    with pytest.raises(ValueError):
        B.SoftmaxBoosting(rounds=2).fit(df.withColumn("label", F.lit(None).cast("int")))
