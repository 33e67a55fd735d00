"""Deterministic report (J6): three recommendations chosen by the winning approach,
plus title and next step, filled from a per-case facts table.

The text formats are the fixed values in ``texts``; here they become, per output
field, a ``CASE`` over the winner of ``concat`` expressions - one narrow
projection, three rows per case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fixed_text
from . import texts as X

TEMPLATES = X.REPORT_RECOMMENDATIONS
FIELDS = ("titulo", "descripcion", "impacto_esperado", "riesgo_o_consideracion")


def _pct0(c: Column) -> Column:
    return fixed_text(c * 100, 0)


def _target(c: Column, default: str) -> Column:
    return F.replace(F.coalesce(c, F.lit(default)), F.lit("_"), F.lit(" "))


def _values() -> dict[str, Column]:
    target = _target(F.col("target"), "la variable de interes")
    perf_cls = F.when(F.col("accuracy").isNotNull(), X.fill(X.PERF_CLASSIFICATION, {"acc": _pct0(F.col("accuracy"))})) \
        .otherwise(F.lit(X.PERF_CLASSIFICATION_NONE))
    perf_reg = F.when(F.col("r2").isNotNull(), X.fill(X.PERF_REGRESSION, {"r2": _pct0(F.col("r2"))})) \
        .otherwise(F.lit(X.PERF_REGRESSION_NONE))
    perf_rl = F.when(F.col("final_reward").isNotNull() & F.col("baseline").isNotNull(),
                     X.fill(X.PERF_BANDIT, {"fr": _pct0(F.col("final_reward")), "base": _pct0(F.col("baseline"))})) \
        .otherwise(F.lit(X.PERF_BANDIT_NONE))
    return {
        "target": target,
        "top": _target(F.col("top_feature"), "el factor mas influyente"),
        "impacto_supervisado": F.when(F.col("task") == "clasificacion",
                                      X.fill(X.IMPACT_CLASSIFICATION, {"target": target, "perf": perf_cls}))
        .otherwise(X.fill(X.IMPACT_REGRESSION, {"target": target, "perf": perf_reg})),
        "k": F.coalesce(F.col("best_k").cast("string"), F.lit("varios")),
        "rasgos": F.when(F.coalesce(F.col("distinctive"), F.lit("")) != "",
                         X.fill(X.DISTINCTIVE, {"distinctive": F.col("distinctive")})).otherwise(F.lit("")),
        "perf_refuerzo": perf_rl,
    }


def report_recommendations(facts: DataFrame) -> DataFrame:
    """(case_id, position, titulo, descripcion, impacto_esperado, riesgo_o_consideracion).

    ``facts`` columns: case_id, winner, target, task, accuracy, r2, top_feature, best_k,
    distinctive, final_reward, baseline (missing values are allowed); any winner other
    than 'unsupervised' / 'reinforcement' gets the supervised recommendations."""
    values = _values()
    w = F.when(F.col("winner").isin("unsupervised", "reinforcement"), F.col("winner")).otherwise(F.lit("supervised"))
    recs = []
    for pos in range(3):
        fields = []
        for fi, name in enumerate(FIELDS):
            expr = None
            for winner, templates in TEMPLATES.items():
                e = X.fill(templates[pos][fi], values)
                expr = F.when(w == winner, e) if expr is None else expr.when(w == winner, e)
            fields.append(expr.alias(name))
        recs.append(F.struct(F.lit(pos + 1).alias("position"), *fields))
    return facts.select("case_id", F.inline(F.array(*recs)))


def report_header(facts: DataFrame) -> DataFrame:
    """Title and next step per case."""
    target = _target(F.col("target"), "la variable de interes")
    return facts.select("case_id", X.fill(X.REPORT_TITLE, {"target_title": F.initcap(target)}).alias("titulo"),
                        X.fill(X.REPORT_NEXT_STEP, {"target": target}).alias("siguiente_paso_sugerido"))


def report_json(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, report): the whole deterministic report as one JSON object per case,
    shaped as J7 expects. ``facts`` adds n_rows, n_cols, goal_label, winner_label and
    domain_label to the columns of ``report_recommendations``; ``findings`` is
    (case_id, finding)."""
    recs = report_recommendations(facts).groupBy("case_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", *FIELDS))),
                    lambda r: F.struct(*[r[f].alias(f) for f in FIELDS])).alias("recomendaciones"))
    target = _target(F.col("target"), "la variable de interes")
    summary = X.fill(X.REPORT_SUMMARY, {
        "domain_clause": F.when(F.col("domain_label").isNotNull(),
                                X.fill(X.DOMAIN_CLAUSE, {"domain_label": F.col("domain_label")})).otherwise(F.lit("")),
        "n_rows": F.col("n_rows"), "n_cols": F.col("n_cols"), "target": target,
        "goal_label": F.lower(F.coalesce(F.col("goal_label"), F.lit("tomar mejores decisiones"))),
        "winner_label": F.lower(F.coalesce(F.col("winner_label"), F.lit("analisis de datos")))})
    head = report_header(facts).join(facts.select("case_id", summary.alias("resumen_situacion")), "case_id")
    full = head.join(findings.select("case_id", F.col("finding").alias("hallazgo_clave")), "case_id", "left") \
               .join(recs, "case_id")
    return full.select("case_id", F.to_json(F.struct(
        "titulo", "resumen_situacion", "hallazgo_clave", "recomendaciones", "siguiente_paso_sugerido")).alias("report"))
