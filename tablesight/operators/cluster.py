"""Clustering (G1-G13): k-means sweep in one job a round, metrics from sufficient statistics.

Nothing here forms point pairs. Per-cluster statistics (size, mean vector, mean
squared norm) are one grouped aggregate of ``k x d`` numbers; they are shipped to
the tasks as literal arrays (bounded by ``MAX_K x d``) and every point computes
its distances to all centroids in a narrow projection. That gives exactly:

* nearest-centroid assignment and inertia, and
* the silhouette with squared Euclidean distance (the definition Spark's
  ``ClusteringEvaluator`` uses): the mean squared distance from ``x`` to
  cluster ``C`` is ``|x|^2 - 2 x.mu_C + mean_C |y|^2``.

The silhouette on plain distances, which chooses k and the quality band, has no such
decomposition; ``cluster_fits.plain_silhouettes`` bounds it without point pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from . import texts as X
from .cluster_fits import Bounds, fit_many, plain_silhouettes

MAX_K = 8
MIN_ROWS = 10
MIN_FEATURES = 2
SEED = 42
MAX_CENTROID_VALUES = 1_000_000
N_STARTS = 10  # starts per k, the lowest cost wins
ROWS_PER_TASK = 25_000  # points that a task of a round takes
GOOD, MODERATE = 0.5, 0.25


def _arr(vec: str) -> Column:
    return F.transform(col(vec), lambda x: x.cast("double"))


def cluster_stats(df: DataFrame, vec: str, cluster: str) -> list[tuple]:
    """[(cluster, n, mean_vector, mean_sq_norm)] - one grouped aggregate, k rows."""
    head = df.select(F.size(col(vec)).alias("d")).first()
    k = df.agg(F.count_distinct(col(cluster)).alias("k")).first()["k"]
    if head is not None and k * max(1, head["d"]) > MAX_CENTROID_VALUES:
        raise ValueError("too many centroid values to ship to the tasks")
    per_c = df.groupBy(col(cluster).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector(_arr(vec))).alias("mean"),
        F.avg(F.aggregate(_arr(vec), F.lit(0.0), lambda a, x: a + x * x)).alias("s"))
    rows = per_c.select("c", "n", "s", vector_to_array("mean").alias("mu")).orderBy("c").collect()  # k rows, checked
    return [(r["c"], int(r["n"]), [float(v) for v in r["mu"]], float(r["s"])) for r in rows]


def _lit_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def _dot(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _sqdist(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def assign_nearest(df: DataFrame, vec: str, centroids: Sequence[tuple], out: str = "cluster") -> DataFrame:
    """Nearest centroid (squared Euclidean); ties go to the smallest cluster id."""
    ids = [c[0] for c in centroids]
    mat = _lit_matrix([c[2] for c in centroids])
    idl = F.array(*[F.lit(i) for i in ids])
    x = _arr(vec)
    d = F.zip_with(F.transform(mat, lambda c: _sqdist(x, c)), idl,
                   lambda dist, i: F.struct(dist.alias("d"), i.alias("c")))
    best = F.array_min(d)
    return df.withColumn(out, best["c"]).withColumn(out + "_sqdist", best["d"])


def inertia(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """One row: sum of squared distances of every point to its own cluster mean."""
    st = cluster_stats(df, vec, cluster)
    ids = F.array(*[F.lit(s[0]) for s in st])
    mat = _lit_matrix([s[2] for s in st])
    own = F.element_at(mat, F.array_position(ids, col(cluster)).cast("int"))
    return df.agg(F.sum(_sqdist(_arr(vec), own)).alias("inertia"))


def silhouette(df: DataFrame, vec: str, cluster: str, stats: list[tuple] | None = None) -> DataFrame:
    """One row: mean squared-Euclidean silhouette (0 for points alone in their cluster;
    0 overall when there is a single cluster)."""
    st = stats or cluster_stats(df, vec, cluster)
    if len(st) < 2:
        return df.sparkSession.createDataFrame([(0.0,)], "silhouette double")
    ids = F.array(*[F.lit(s[0]) for s in st])
    ns = F.array(*[F.lit(float(s[1])) for s in st])
    ss = F.array(*[F.lit(s[3]) for s in st])
    mat = _lit_matrix([s[2] for s in st])
    x = _arr(vec)
    xx = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    # Mean squared distance to every cluster, as an array aligned with ids.
    md = F.zip_with(F.transform(mat, lambda c: _dot(x, c)), ss, lambda dot, s: xx - 2 * dot + s)
    pos = F.array_position(ids, col(cluster)).cast("int")
    n_own = F.element_at(ns, pos)
    a = F.element_at(md, pos) * n_own / (n_own - 1)
    others = F.filter(F.zip_with(md, ids, lambda m, i: F.struct(m.alias("m"), i.alias("i"))),
                      lambda t: t["i"] != col(cluster))
    b = F.array_min(F.transform(others, lambda t: t["m"]))
    s = F.when(n_own <= 1, F.lit(0.0)).otherwise(
        F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(F.lit(0.0)))
    return df.agg(F.avg(s).alias("silhouette"))


def quality_band(s: Column) -> Column:
    return (F.when(s > GOOD, F.lit("buena")).when(s > MODERATE, F.lit("moderada"))
            .otherwise(F.lit("debil")))


def band_of(s: float) -> str:
    return "buena" if s > GOOD else "moderada" if s > MODERATE else "debil"


def decided(bounds: Sequence[Bounds]) -> bool:
    """True if the bounds tell the best labelling (the first of equals) and its quality band."""
    best = max(range(len(bounds)), key=lambda i: (bounds[i].low, -i))
    others = [b.high for i, b in enumerate(bounds) if i != best]
    return all(h < bounds[best].low for h in others) and band_of(bounds[best].low) == band_of(bounds[best].high)


def score_norm(s: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s + 1) / 2))


def cluster_counts(n: int) -> list[int]:
    """G1: two clusters always, more while each would have five rows, up to ``MAX_K``."""
    return [2, *(k for k in range(3, MAX_K + 1) if 5 * k <= n)]


def best_k(sweep: DataFrame) -> DataFrame:
    """The k with the highest silhouette; the smallest k on ties."""
    w = Window.orderBy(F.col("silhouette").desc(), F.col("k"))
    return sweep.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, pct) with pct = 100 n / total rounded to 1."""
    sizes = df.groupBy(col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())  # k rows
    return sizes.select("cluster", F.col("n").cast("long"), F.round(F.col("n") * 100.0 / tot, 1).alias("pct"))


def cluster_profile(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each numeric column per cluster."""
    return df.groupBy(col(cluster).alias("cluster")).agg(
        *[F.avg(col(c).cast("double")).alias(c) for c in columns])


def overall_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each numeric column over the whole table."""
    return df.agg(*[F.avg(col(c).cast("double")).alias(c) for c in columns])


def distinctive_features(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per cluster, the column whose cluster mean is farthest from the mean of the
    cluster means (raw units, first column on ties), and whether it is high or low."""
    long = profile.select("cluster", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("mean"))
        for i, c in enumerate(columns)])))
    w_col = Window.partitionBy("column_name")  # one partition per column, k rows each
    d = long.withColumn("center", F.avg("mean").over(w_col)).withColumn("gap", F.abs(F.col("mean") - F.col("center")))
    w = Window.partitionBy("cluster").orderBy(F.col("gap").desc(), F.col("ordinal"))
    top = d.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    return top.select("cluster", "column_name",
                      F.when(F.col("mean") > F.col("center"), F.lit("alto")).otherwise(F.lit("bajo"))
                      .alias("direction"))


def traits_text(profile: DataFrame, columns: Sequence[str]) -> str:
    """G9 as one text for the report; one row per cluster comes to the driver."""
    if not columns:
        return ""
    top = distinctive_features(profile, columns)
    line = X.fill(X.CLUSTER_TRAIT, {"cluster": F.col("cluster").cast("string"), "column_name": F.col("column_name"), "direction": F.col("direction")})
    return "; ".join(r["line"] for r in top.orderBy("cluster").select(line.alias("line")).collect())


@dataclass
class ClusterResult:
    status: str
    best_k: int | None = None
    silhouette: float | None = None
    quality: str | None = None
    score_norm: float = 0.0
    #: (k, inertia, silhouette, its error) of every k; the silhouette is on plain distances.
    sweep: list[tuple[int, float, float, float]] = field(default_factory=list)
    #: False if the bounds of two numbers of clusters, or of two quality bands, still overlap.
    decided: bool = True
    assignments: DataFrame | None = None
    centres: list[list[float]] | None = None
    reason: str | None = None


def kmeans_sweep(df: DataFrame, key: str, features_col: str, ks: Sequence[int] | None = None,
                 seed: int = SEED, n_starts: int = N_STARTS) -> ClusterResult:
    """Fit k-means for each k on the persisted standardised vectors, all
    starts together, score inertia and the plain-distance silhouette, and keep the best (no
    refit). Where the bounds of silhouettes overlap, the middle decides."""
    data = df.select(col(key), vector_to_array(col(features_col)).alias("__v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = data.count()
        if n < MIN_ROWS:
            return ClusterResult("skipped", reason="datos insuficientes")
        if n > ROWS_PER_TASK:  # a small file of very many rows is one task otherwise, in every round
            spread = data.repartition(math.ceil(n / ROWS_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)
            spread.count()
            data.unpersist()
            data = spread
        ks = list(ks or cluster_counts(n))
        fits = fit_many(data, key, "__v", ks, n_starts, seed)
        bounds, sure = plain_silhouettes(data, "__v", [fits[k][0] for k in ks], decided)
        sweep = [(k, fits[k][1], b.middle, (b.high - b.low) / 2) for k, b in zip(ks, bounds)]
        best, _, sil, _ = max(sweep, key=lambda r: (r[2], -r[0]))
        centres = [c.tolist() for c in fits[best][0]]
        assign = assign_nearest(df.withColumn("__v", vector_to_array(col(features_col))), "__v",
                                [(i, 0, c) for i, c in enumerate(centres)]).select(key, "cluster")
        return ClusterResult("ok", best_k=best, silhouette=sil, quality=band_of(sil), score_norm=float(min(1.0, max(0.0, (sil + 1) / 2))),
                             sweep=sweep, decided=sure, assignments=assign, centres=centres)
    finally:
        data.unpersist()


def as_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[col(c).cast("double") for c in columns])))


def principal_axes(df: DataFrame, features_col: str, k: int = 3) -> tuple[list[float], list[list[float]]]:
    """Means, and the ``min(k, d)`` eigenvectors of the covariance with the largest
    eigenvalues, from one aggregate of d (d + 1) / 2 sums of products. An axis points where
    its largest entry (the first of equals, up to rounding) is positive."""
    x = vector_to_array(col(features_col))
    row = df.agg(Summarizer.mean(col(features_col)).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return [], []
    mean = np.array(row["m"])
    d = len(mean)
    # centred before the products, so that nothing cancels
    z = [x[i] - F.lit(float(mean[i])) for i in range(d)]
    sums = df.agg(*[F.sum(z[i] * z[j]) for i in range(d) for j in range(i, d)]).first()
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = [float(v) for v in sums]
    _, vectors = np.linalg.eigh((cov + np.triu(cov, 1).T) / max(1, row["n"] - 1))
    axes = []
    for v in vectors.T[::-1][:min(k, d)]:
        top = int(np.nonzero(np.abs(v) >= np.abs(v).max() - 1e-9)[0][0])
        axes.append((v * (1.0 if v[top] >= 0 else -1.0)).tolist())
    return mean.tolist(), axes


def pca_projection(df: DataFrame, features_col: str, k: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """The centred features on their ``min(k, d)`` principal axes, with a fixed sign."""
    mean, axes = principal_axes(df, features_col, k)
    centred = F.zip_with(vector_to_array(col(features_col)), F.array(*[F.lit(m) for m in mean]), lambda a, b: a - b)
    out = df.withColumn("__centred", centred)
    return out.select(*[col(c) for c in keep],
                      *[_dot(F.col("__centred"), F.array(*[F.lit(v) for v in axis])).alias(f"pc{i + 1}") for i, axis in enumerate(axes)])
