"""Checked query for the whole analysis (O1-O4), rows-only (model fits are not SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .analysis import run_all
from .registry import register
from .tables import sql

_SQL = ("SELECT l.doc_id, l.quality, d.n_chars, d.lang, d.source FROM labels l "
        "JOIN documents d ON l.doc_id = d.doc_id")


@register("analyze_table")
def q_analyze_table(spark, sf):
    df = sql(spark, sf, _SQL, ("labels", "documents"))
    d, a = run_all(df, key="doc_id", goal="predecir", name="documentos_etiquetados", target="quality")
    winner = a.recommendation.select("case_id", "winner", "final_score")
    return a.status.join(winner, "case_id", "left").select(
        "approach", "status", F.round("score_norm", 6).alias("score_norm"), "detail", "winner", "final_score")
