"""Checked queries for clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..functions.ordered import global_row_number
from ..operators import cluster as C
from ..operators.cluster_fits import plain_silhouettes
from ..operators.features import standardize
from .registry import register
from .tables import load

_EMB = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_EMB_LONG = f"""e AS ({_EMB}),
u AS (SELECT vec_id, label, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM e),
c AS (SELECT label, i, avg(x) AS c FROM u GROUP BY label, i)"""


@register("inertia", f"""
WITH {_EMB_LONG}
SELECT round(sum((x - c) * (x - c)), 4) AS inertia FROM u JOIN c ON u.label = c.label AND u.i = c.i""")
def q_inertia(spark, sf):
    emb = load(spark, sf, "embeddings")
    return C.inertia(emb, "embedding", "label").select(F.round("inertia", 4).alias("inertia"))


@register("silhouette", f"""
WITH e AS ({_EMB}),
p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) * list_distance(a.v, b.v) AS d2
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, la, lb, avg(d2) AS md FROM p GROUP BY vec_id, la, lb),
s AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
      FROM m GROUP BY vec_id),
r AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM s)
SELECT round(sil, 6) AS silhouette,
       CASE WHEN sil > 0.5 THEN 'buena' WHEN sil > 0.25 THEN 'moderada' ELSE 'debil' END AS quality,
       round(greatest(0, least(1, (sil + 1) / 2)), 6) AS score_norm FROM r""")
def q_silhouette(spark, sf):
    emb = load(spark, sf, "embeddings")
    s = C.silhouette(emb, "embedding", "label")
    return round_doubles(s.select("silhouette", C.quality_band(F.col("silhouette")).alias("quality"),
                                  C.score_norm(F.col("silhouette")).alias("score_norm")))


@register("assign_clusters", f"""
WITH {_EMB_LONG}, cl AS (SELECT label, list(c ORDER BY i) AS cv FROM c GROUP BY label)
SELECT vec_id, arg_min(cl.label, list_distance(e.v, cl.cv)) AS cluster FROM e, cl GROUP BY vec_id""")
def q_assign_clusters(spark, sf):
    emb = load(spark, sf, "embeddings")
    cents = C.cluster_stats(emb, "embedding", "label")
    return C.assign_nearest(emb, "embedding", cents).select("vec_id", "cluster")


_SWEEP_SQL = """
WITH c AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS r,
                  count(*) OVER () AS n FROM customer),
z AS (SELECT c_custkey, r, n, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x FROM c),
ks AS (SELECT unnest(range(2, 9)) AS k),
a AS (SELECT k, c_custkey, x, floor(r * k / n) AS cl FROM z, ks),
p AS (SELECT a.k, a.c_custkey, a.cl AS la, b.cl AS lb, (a.x - b.x) * (a.x - b.x) AS d2
      FROM a JOIN a b ON a.k = b.k AND a.c_custkey <> b.c_custkey),
m AS (SELECT k, c_custkey, la, lb, avg(d2) AS md FROM p GROUP BY k, c_custkey, la, lb),
s AS (SELECT k, c_custkey, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b
      FROM m GROUP BY k, c_custkey),
sw AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM s GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, round(sil, 6) AS silhouette FROM sw ORDER BY sil DESC, k LIMIT 1"""


@register("best_k", _SWEEP_SQL)
def q_best_k(spark, sf):
    cust = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    z, _ = standardize(cust, ["c_acctbal"], suffix="_z")
    ranked = global_row_number(z, ["c_acctbal", "c_custkey"], name="r")
    n = ranked.count()
    vec = ranked.withColumn("v", F.array(F.col("c_acctbal_z")))
    rows = []
    for k in C.cluster_counts(n):
        clustered = vec.withColumn("cl", F.floor(F.col("r") * k / F.lit(n)))
        rows.append((k, clustered, C.silhouette(clustered, "v", "cl")))
    sweep = rows[0][2].select(F.lit(rows[0][0]).cast("long").alias("k"), "silhouette")
    for k, _, s in rows[1:]:
        sweep = sweep.unionByName(s.select(F.lit(k).cast("long").alias("k"), "silhouette"))
    return round_doubles(C.best_k(sweep))


_SEG = "SELECT c_custkey, c_mktsegment AS cluster, c_acctbal, c_nationkey FROM customer"


@register("cluster_sizes", f"""
SELECT cluster, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 1) AS pct
FROM ({_SEG}) GROUP BY cluster""")
def q_cluster_sizes(spark, sf):
    seg = load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "cluster")
    return round_doubles(C.cluster_sizes(seg, "cluster"))


@register("cluster_profile", f"""
SELECT cluster, round(avg(c_acctbal), 6) AS c_acctbal, round(avg(CAST(c_nationkey AS DOUBLE)), 6) AS c_nationkey
FROM ({_SEG}) GROUP BY cluster""")
def q_cluster_profile(spark, sf):
    seg = load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "cluster")
    return round_doubles(C.cluster_profile(seg, "cluster", ["c_acctbal", "c_nationkey"]))


@register("distinctive_features", f"""
WITH pr AS (SELECT cluster, avg(c_acctbal) AS c_acctbal, avg(CAST(c_nationkey AS DOUBLE)) AS c_nationkey
            FROM ({_SEG}) GROUP BY cluster),
l AS (SELECT cluster, 0 AS ordinal, 'c_acctbal' AS column_name, c_acctbal AS mean FROM pr
      UNION ALL SELECT cluster, 1, 'c_nationkey', c_nationkey FROM pr),
d AS (SELECT *, avg(mean) OVER (PARTITION BY column_name) AS center FROM l)
SELECT cluster, column_name, CASE WHEN mean > center THEN 'alto' ELSE 'bajo' END AS direction FROM d
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY abs(mean - center) DESC, ordinal) = 1""")
def q_distinctive_features(spark, sf):
    seg = load(spark, sf, "customer").withColumnRenamed("c_mktsegment", "cluster")
    prof = C.cluster_profile(seg, "cluster", ["c_acctbal", "c_nationkey"])
    return C.distinctive_features(prof, ["c_acctbal", "c_nationkey"])


@register("overall_means", """
SELECT round(avg(c_acctbal), 6) AS c_acctbal, round(avg(CAST(c_nationkey AS DOUBLE)), 6) AS c_nationkey FROM customer""")
def q_overall_means(spark, sf):
    return round_doubles(C.overall_means(load(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]))


def _customer_vectors(spark, sf):
    cust = load(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    z, _ = standardize(cust, ["c_acctbal", "c_nationkey"], suffix="_z")
    return C.as_vector(z, ["c_acctbal_z", "c_nationkey_z"])


def _all_pairs(e: str, groups: str) -> str:
    """CTEs with the plain-distance silhouette over all pairs, as ``r(groups, sil)``."""
    g = groups + ", " if groups else ""
    same = "".join(f"a.{c} = b.{c} AND " for c in groups.split(", ") if c)
    return f"""p AS (SELECT {"".join(f"a.{c}, " for c in groups.split(", ") if c)}a.id, a.cl AS la, b.cl AS lb, list_distance(a.v, b.v) AS dist
      FROM {e} a JOIN {e} b ON {same}a.id <> b.id),
m AS (SELECT {g}id, la, lb, avg(dist) AS md FROM p GROUP BY {g}id, la, lb),
s AS (SELECT {g}id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM m GROUP BY {g}id),
r AS (SELECT {g}avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM s {"GROUP BY " + groups if groups else ""})"""


_BAND_SQL = "CASE WHEN sil > 0.5 THEN 'buena' WHEN sil > 0.25 THEN 'moderada' ELSE 'debil' END"


@register("silhouette_plain", f"""
WITH e AS (SELECT vec_id AS id, label AS cl, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{_all_pairs("e", "")}
SELECT {_BAND_SQL} AS quality, true AS decided FROM r""")
def q_silhouette_plain(spark, sf):
    """The quality band of the labels on plain distances, decided by bounds without point pairs."""
    emb = load(spark, sf, "embeddings")
    bounds, sure = plain_silhouettes(emb, "embedding", ["label"], C.decided)
    return spark.createDataFrame([(C.band_of(bounds[0].middle), sure)], "quality string, decided boolean")


@register("best_k_plain", f"""
WITH c AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer),
z AS (SELECT c_custkey AS id, r, n, [(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()] AS v FROM c),
e AS (SELECT k, id, v, floor(r * k / n) AS cl FROM z, (SELECT unnest(range(2, 9)) AS k)),
{_all_pairs("e", "k")}
SELECT CAST(k AS BIGINT) AS k, {_BAND_SQL} AS quality, true AS decided FROM r ORDER BY sil DESC, k LIMIT 1""")
def q_best_k_plain(spark, sf):
    """Which number of equal-count ranges of the account balance clusters best, on plain distances."""
    cust = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    z, _ = standardize(cust, ["c_acctbal"], suffix="_z")
    ranked = global_row_number(z, ["c_acctbal", "c_custkey"], name="r")
    n = ranked.count()
    ks = C.cluster_counts(n)
    vec = ranked.select(F.array("c_acctbal_z").alias("v"), *[F.floor(F.col("r") * k / F.lit(n)).alias(f"c{k}") for k in ks]).persist()
    try:
        bounds, sure = plain_silhouettes(vec, "v", [f"c{k}" for k in ks], C.decided)
    finally:
        vec.unpersist()
    k, best = max(zip(ks, bounds), key=lambda x: (x[1].middle, -x[0]))
    return spark.createDataFrame([(k, C.band_of(best.middle), sure)], "k long, quality string, decided boolean")


@register("kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    res = C.kmeans_sweep(_customer_vectors(spark, sf), "c_custkey", "features")
    df = spark.createDataFrame(res.sweep, "k int, inertia double, silhouette double, error double")
    return df.withColumn("quality", C.quality_band(F.col("silhouette"))).withColumn(
        "is_best", F.col("k") == F.lit(res.best_k))


# Two standardised columns: the covariance is [[1, r], [r, 1]], so the axes are (1, 1) and
# (1, -1) over the root of 2; the first one holds more variance when r > 0.
@register("pca_projection", """
WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS a,
                  (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS b FROM customer),
s AS (SELECT corr(a, b) AS r FROM z)
SELECT c_custkey, round(CASE WHEN r > 0 THEN a + b ELSE a - b END / sqrt(2), 6) AS pc1,
       round(CASE WHEN r > 0 THEN a - b ELSE a + b END / sqrt(2), 6) AS pc2 FROM z, s""")
def q_pca_projection(spark, sf):
    return round_doubles(C.pca_projection(_customer_vectors(spark, sf), "features", keep=["c_custkey"]))
