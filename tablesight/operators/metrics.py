"""Model metrics on a predictions table (F8-F13, F21, F22), all as aggregates.

Classification metrics reduce the predictions to ``groupBy(y, p).count()``
first (map-side partial aggregation, classes^2 rows), so they cost one pass.
ROC AUC is exact (average ranks for ties): scores are reduced to distinct
``(score, n, n_pos)`` and ranked with a range-bucketed running sum, never a
single-task global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.ordered import running_sums


def pair_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(col(y).alias("y"), col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: n, accuracy, f1_macro (classes = union of true and predicted,
    zero division -> 0)."""
    pc = pair_counts(df, y, p)
    per_true = pc.groupBy(F.col("y").alias("c")).agg(
        F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0)).alias("fn"))
    per_pred = pc.groupBy(F.col("p").alias("c")).agg(
        F.sum(F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0)).alias("fp"))
    cls = per_true.join(per_pred, "c", "full_outer").select(
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fn", F.lit(0)).alias("fn"),
        F.coalesce("fp", F.lit(0)).alias("fp"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = cls.agg(F.avg(F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(0.0)).alias("f1_macro"))
    acc = pc.agg(F.sum("n").cast("long").alias("n"),
                 (F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return acc.crossJoin(f1)


def roc_auc(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """One row: n_pos, n_neg, auc (Mann-Whitney with average ranks; null if one class)."""
    by_score = df.groupBy(col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.sum(F.when(col(y) == F.lit(positive), 1).otherwise(0)).alias("pos"))
    ranked = running_sums(by_score, ["s"], {"cum": F.col("cnt")})
    avg_rank = F.col("cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    agg = ranked.agg(F.sum(F.col("pos") * avg_rank).alias("rsum"), F.sum("pos").alias("n_pos"),
                     F.sum(F.col("cnt") - F.col("pos")).alias("n_neg"))
    auc = (F.col("rsum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * F.col("n_neg"))
    return agg.select(F.col("n_pos").cast("long"), F.col("n_neg").cast("long"),
                      F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc).alias("auc"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: n, r2, mae, rmse."""
    ym = df.agg(F.avg(col(y).cast("double"))).first()[0]  # one scalar, used as a literal
    e = col(y).cast("double") - col(p).cast("double")
    a = df.agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(e * e).alias("sse"),
               F.sum(F.pow(col(y).cast("double") - F.lit(ym), 2)).alias("sst"),
              F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return a.select("n", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(F.lit(0.0)).alias("r2"),
                    "mae", "rmse")


def confusion_matrix(df: DataFrame, y: str, p: str, zero_cells: bool = True) -> DataFrame:
    """Long confusion matrix (actual, predicted, n); the label set is the union of actual
    and predicted values. With ``zero_cells`` it has classes^2 rows, by a pivot of the
    (y, p) counts; without, only the pairs that occur, for any number of classes."""
    pc = pair_counts(df, y, p)
    if not zero_cells:
        return pc.select(F.col("y").alias("actual"), F.col("p").alias("predicted"), F.col("n").cast("long").alias("n"))
    labels = pc.select(F.col("y").alias("l")).union(pc.select(F.col("p").alias("l"))).distinct()
    values = sorted((r["l"] for r in labels.collect()), key=lambda v: (v is None, v))
    wide = pc.groupBy("y").pivot("p", values).agg(F.sum("n"))
    full = labels.join(wide, labels["l"] == wide["y"], "left")
    cells = [F.struct(F.lit(v).alias("predicted"), F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias("n"))
             for v in values]
    out = full.select(F.col("l").alias("actual"), F.inline(F.array(*cells)))
    return out.select("actual", F.col("predicted").cast(df.schema[p].dataType).alias("predicted"),
                      F.col("n").cast("long").alias("n"))


def actual_vs_predicted(df: DataFrame, y: str, p: str, keep=()) -> DataFrame:
    """Pairs plus the identity-line range [min(y, p), max(y, p)] on every row."""
    r = df.agg(F.least(F.min(col(y)), F.min(col(p))).cast("double").alias("line_lo"),
               F.greatest(F.max(col(y)), F.max(col(p))).cast("double").alias("line_hi")).first()
    return df.select(*[col(k) for k in keep], col(y).cast("double").alias("actual"),
                     col(p).cast("double").alias("predicted"),
                     F.lit(r["line_lo"]).cast("double").alias("line_lo"),
                     F.lit(r["line_hi"]).cast("double").alias("line_hi"))
