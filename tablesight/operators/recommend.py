"""Recommendation (I1-I6): weight each successful approach's normalised score by the
business goal and pick a winner, for many cases (and goals) at once.

Inputs are long tables: ``scores(case_id, approach, status, score_norm)`` and
``requests(case_id, goal)``. The 4x3 weight table is broadcast; rankings are
windows over (case, goal) groups of at most three rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fixed_text
from . import vocabulary as V

APPROACH_ORDER = {a: i for i, a in enumerate(V.APPROACHES)}


def _order_col():
    return F.element_at(F.create_map(*[x for a, i in APPROACH_ORDER.items() for x in (F.lit(a), F.lit(i))]),
                        F.col("approach"))


def approach_scores(results: DataFrame) -> DataFrame:
    """Normalised scores of the approaches that finished with status 'ok'."""
    return results.filter(F.col("status") == "ok").select("case_id", "approach", F.col("score_norm").cast("double"))


def weighted_scores(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """final = round(score_norm * weight[goal, approach], 4); weight 0.5 when the pair
    is unknown; an unknown goal falls back to 'explorar'."""
    spark = scores.sparkSession
    weights = V.weights_frame(spark)
    goals = [g for g in V.GOALS]
    req = requests.select("case_id", "goal", F.when(F.lower(F.col("goal")).isin(*goals), F.lower(F.col("goal")))
                          .otherwise(F.lit(V.DEFAULT_GOAL)).alias("eff_goal"))
    j = req.join(approach_scores(scores) if "status" in scores.columns else scores, "case_id")
    w = F.broadcast(weights.select(F.col("goal").alias("eff_goal"), "approach", "weight"))
    out = j.join(w, ["eff_goal", "approach"], "left")
    out = out.withColumn("weight", F.coalesce("weight", F.lit(V.DEFAULT_WEIGHT)))
    return out.select("case_id", "goal", "eff_goal", "approach", "score_norm", "weight",
                      F.round(F.col("score_norm") * F.col("weight"), 4).alias("final_score"))


def ranking(weighted: DataFrame) -> DataFrame:
    """I4: rank of each approach within (case, goal), best first; ties keep the approach order."""
    w = Window.partitionBy("case_id", "goal").orderBy(F.col("final_score").desc(), _order_col())
    return weighted.withColumn("rank", F.row_number().over(w).cast("long"))


def recommendation(weighted: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The winner per (case, goal); status 'empty' when no approach succeeded."""
    lab = F.create_map(*[x for a, l in V.APPROACH_LABELS.items() for x in (F.lit(a), F.lit(l))])
    top = ranking(weighted).filter(F.col("rank") == 1).select(
        "case_id", "goal", "eff_goal", F.col("approach").alias("winner"),
        F.element_at(lab, F.col("approach")).alias("winner_label"), "final_score")
    if requests is None:
        return top.withColumn("status", F.lit("ok"))
    return (requests.select("case_id", "goal").join(top, ["case_id", "goal"], "left")
            .withColumn("status", F.when(F.col("winner").isNull(), F.lit("empty")).otherwise(F.lit("ok"))))


def ranking_text(weighted: DataFrame) -> DataFrame:
    """I4 text: 'label: calidad s x peso w = f' joined by '; ', best first."""
    lab = F.create_map(*[x for a, l in V.APPROACH_LABELS.items() for x in (F.lit(a), F.lit(l))])
    from . import texts as X
    r = ranking(weighted).withColumn("piece", X.fill(X.RANKING_PIECE, {
        "label": F.element_at(lab, F.col("approach")), "score": fixed_text(F.col("score_norm"), 2),
        "weight": fixed_text(F.col("weight"), 1), "final": fixed_text(F.col("final_score"), 2)}))
    return r.groupBy("case_id", "goal").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "piece"))), lambda s: s["piece"]),
                     "; ").alias("ranking_text"))
