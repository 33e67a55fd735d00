import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablesight.operators import cluster as C
from tablesight.operators import cluster_fits as CF


def test_sums_equal_plain_assignment_with_ties(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(500, 3)), np.zeros((7, 3))]
    models = [np.array([[1.0, 0, 0], [-1.0, 0, 0], [3.0, 3, 3]]), rng.normal(size=(5, 3))]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    got = CF._sums(df, "v", models)
    for i, m in enumerate(models):
        square = ((x[:, None] - m) ** 2).sum(2)
        near = square.argmin(1)  # of equals the first
        for c in range(len(m)):
            n = int((near == c).sum())
            assert got[i].get(c, (0,))[0] == n
            if n:
                np.testing.assert_allclose(got[i][c][1], x[near == c].sum(0), atol=1e-9)
                np.testing.assert_allclose(got[i][c][2], square[near == c, c].sum(), atol=1e-9)


def test_points_of_one_file_part_are_spread(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS_PER_TASK", 100)
    parts = []
    monkeypatch.setattr(C, "fit_many", lambda data, *a: parts.append(data.rdd.getNumPartitions()) or CF.fit_many(data, *a))
    df = spark.range(400).coalesce(1).select("id", array_to_vector(F.array((F.col("id") % 2 * 9 + F.col("id") % 7 * 0.1), F.rand(1))).alias("f"))
    res = C.kmeans_sweep(df, "id", "f", ks=[2], n_starts=2)
    assert parts == [4] and res.best_k == 2 and res.quality == "buena"
