"""Batched k-means and silhouette bounds against plain numpy over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.operators import cluster as C
from tablesight.operators import cluster_fits as CF


def brute(x, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i, c in enumerate(label):
        own = (label == c).sum()
        if own == 1:
            s.append(0.0)
            continue
        a = d[i][label == c].sum() / (own - 1)
        b = min(d[i][label == o].mean() for o in set(label.tolist()) if o != c)
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def frame(spark, x, *labels):
    rows = [(i, v.tolist(), *[int(label[i]) for label in labels]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key long, v array<double>" + "".join(f", c{j} int" for j in range(len(labels)))).repartition(2)


def data(n, d, groups, seed=1):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(0, 4, (groups, d))
    label = rnd.integers(0, groups, n)
    return centre[label] + rnd.normal(0, 1, (n, d)), label


@pytest.mark.parametrize("d, groups", [(1, 3), (2, 4), (5, 3)])
def test_bounds_hold_and_shrink(spark, d, groups):
    x, label = data(500, d, groups)
    x[:40] = x[0]  # repeated points
    label[:40] = label[0]
    other = (label + (np.arange(len(x)) % 7 == 0)) % groups
    label = label.copy()
    label[-1] = groups  # alone in its cluster
    df = frame(spark, x, label, other)
    exact = [brute(x, label), brute(x, other)]
    width = []
    for bits, apart in CF.REFINEMENTS:
        got = CF.silhouette_bounds(df, "v", ["c0", "c1"], bits, apart)
        assert all(b.low <= e <= b.high for b, e in zip(got, exact))
        width.append(max(b.high - b.low for b in got))
    assert width[-1] < 0.05 and width[-1] < width[0] / 2


def test_decides_band_and_best(spark):
    x, label = data(600, 2, 3, seed=5)
    wrong = (np.arange(600) % 3).astype(int)
    df = frame(spark, x, label, wrong)
    bounds, done = CF.plain_silhouettes(df, "v", ["c0", "c1"], C.decided)
    assert done and bounds[0].low > bounds[1].high
    assert C.band_of(bounds[0].middle) == C.band_of(brute(x, label))
    one, _ = CF.plain_silhouettes(frame(spark, x, np.zeros(600)), "v", ["c0"], C.decided)
    assert one == [CF.Bounds(0.0, 0.0)]


def test_fits_are_no_worse_than_single_ones(spark):
    from pyspark.ml.clustering import KMeans

    x, _ = data(400, 2, 5, seed=3)
    df = frame(spark, x).persist()
    fits = CF.fit_many(df, "key", "v", [2, 5, 8], starts=10)
    vectors = df.withColumn("features", C.array_to_vector("v"))
    for k, (centres, cost) in fits.items():
        assert cost == pytest.approx(float(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()))
        assert cost <= min(KMeans(k=k, seed=s).fit(vectors).summary.trainingCost for s in (1,)) * 1.001


def test_few_distinct_points_and_empty(spark):
    x = np.array([[0.0, 0.0]] * 6 + [[1.0, 1.0]] * 6)
    centres, cost = CF.fit_many(frame(spark, x).persist(), "key", "v", [2, 4])[4]
    assert cost == 0.0 and len(centres) == 4
    assert CF.fit_many(frame(spark, x).limit(0), "key", "v", [2]) == {}


def test_pca_sign_and_components(spark):
    x = np.random.default_rng(2).normal(0, 1, (300, 4)) * [3, 2, 1, 0.5]
    df = C.as_vector(spark.createDataFrame(x.tolist(), "a double, b double, c double, d double"), list("abcd"))
    got = C.pca_projection(df, "features").toPandas()
    assert got.shape == (300, 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for i in range(3):
        v = vectors[:, -1 - i]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(np.sort(got[f"pc{i + 1}"]), np.sort((x - x.mean(0)) @ v), atol=1e-8)
    one = C.as_vector(spark.createDataFrame([(1.0,), (2.0,)], "a double"), ["a"])
    assert C.pca_projection(one, "features").columns == ["pc1"]
