"""Checked queries for the recommendation stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import recommend as R
from ..operators import vocabulary as V
from .registry import register
from .tables import derived, derived_duck

# Per-case approach scores derived from the finance table (one case per customer
# segment); the reinforcement approach "fails" for some cases.
_SCORES = (
    "SELECT segmento_cliente AS case_id, 'supervised' AS approach, 'ok' AS status, "
    "CAST(avg(churn) AS DOUBLE) AS score_norm FROM finanzas GROUP BY segmento_cliente "
    "UNION ALL SELECT segmento_cliente, 'unsupervised', 'ok', "
    "CAST(avg(CASE WHEN saldo_cuenta > 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM finanzas GROUP BY segmento_cliente "
    "UNION ALL SELECT segmento_cliente, 'reinforcement', CASE WHEN count(*) % 2 = 0 THEN 'ok' ELSE 'failed' END, "
    "CAST(avg(CASE WHEN monto_transaccion > 200000 THEN 1 ELSE 0 END) AS DOUBLE) FROM finanzas GROUP BY segmento_cliente")
GOALS = list(V.GOALS) + ["crecer"]  # plus one unknown goal (falls back to 'explorar')

_W = ", ".join(f"('{g}', '{a}', {V.GOAL_WEIGHTS[g][a]})" for g in V.GOALS for a in V.APPROACHES)
_G = ", ".join(f"('{g}')" for g in GOALS)
_ORDER = "CASE approach WHEN 'supervised' THEN 0 WHEN 'unsupervised' THEN 1 ELSE 2 END"
_CTES = f"""WITH finanzas AS ({derived_duck('finanzas')}), scores AS ({_SCORES}),
req AS (SELECT DISTINCT s.case_id, g.goal FROM scores s, (VALUES {_G}) g(goal)),
w(goal, approach, weight) AS (VALUES {_W}),
ws AS (SELECT r.case_id, r.goal, CASE WHEN lower(r.goal) IN ({', '.join(f"'{g}'" for g in V.GOALS)})
              THEN lower(r.goal) ELSE 'explorar' END AS eff_goal, s.approach, s.score_norm
       FROM req r JOIN scores s ON r.case_id = s.case_id WHERE s.status = 'ok'),
fw AS (SELECT ws.*, CAST(coalesce(w.weight, 0.5) AS DOUBLE) AS weight,
              round(score_norm * CAST(coalesce(w.weight, 0.5) AS DOUBLE), 4) AS final_score
       FROM ws LEFT JOIN w ON w.goal = ws.eff_goal AND w.approach = ws.approach),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, goal ORDER BY final_score DESC, {_ORDER}) AS rank FROM fw)"""


def _scores(spark, sf):
    derived(spark, sf, "finanzas").createOrReplaceTempView("finanzas")
    return spark.sql(_SCORES)


def _requests(scores):
    return scores.select("case_id").distinct().withColumn("goal", F.explode(F.array(*[F.lit(g) for g in GOALS])))


def _weighted(spark, sf):
    s = _scores(spark, sf)
    return R.weighted_scores(s, _requests(s))


@register("approach_scores", _CTES + " SELECT case_id, approach, round(score_norm, 6) AS score_norm FROM scores "
          "WHERE status = 'ok'")
def q_approach_scores(spark, sf):
    return round_doubles(R.approach_scores(_scores(spark, sf)))


@register("weighted_scores", _CTES + """ SELECT case_id, goal, eff_goal, approach, round(score_norm, 6) AS score_norm,
    weight, final_score FROM fw""")
def q_weighted_scores(spark, sf):
    return round_doubles(_weighted(spark, sf))


@register("recommendation", _CTES + """ SELECT case_id, goal, eff_goal, approach AS winner,
    CASE approach WHEN 'supervised' THEN 'Aprendizaje supervisado' WHEN 'unsupervised' THEN 'Aprendizaje no supervisado'
    ELSE 'Aprendizaje por refuerzo (bandit)' END AS winner_label, final_score, 'ok' AS status FROM rk WHERE rank = 1""")
def q_recommendation(spark, sf):
    s = _scores(spark, sf)
    return round_doubles(R.recommendation(R.weighted_scores(s, _requests(s)), _requests(s)))


@register("ranking", _CTES + " SELECT case_id, goal, CAST(rank AS BIGINT) AS rank, approach, final_score FROM rk")
def q_ranking(spark, sf):
    return round_doubles(R.ranking(_weighted(spark, sf)).select("case_id", "goal", "rank", "approach", "final_score"))


_LABEL_SQL = "CASE approach " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in V.APPROACH_LABELS.items()) + " END"


@register("ranking_text", _CTES + f""" SELECT case_id, goal, string_agg({_LABEL_SQL} || ': calidad ' || printf('%.2f', score_norm)
    || ' x peso ' || printf('%.1f', weight) || ' = ' || printf('%.2f', final_score), '; ' ORDER BY rank) AS ranking_text
    FROM rk GROUP BY case_id, goal""")
def q_ranking_text(spark, sf):
    return R.ranking_text(_weighted(spark, sf))


# ---- J6: the deterministic report built from each (case, goal) recommendation ----
from ..operators import report_text as RT  # noqa: E402


def _report_facts(spark, sf):
    s = _scores(spark, sf)
    rec = R.recommendation(R.weighted_scores(s, _requests(s)))
    sc = s.filter(F.col("status") == "ok").groupBy("case_id").pivot("approach", list(V.APPROACHES)).agg(
        F.first("score_norm"))
    return (rec.join(sc, "case_id").select(
        F.concat_ws(":", "case_id", "goal").alias("case_id"), "winner", F.lit("churn").alias("target"),
        F.lit("clasificacion").alias("task"), F.col("supervised").alias("accuracy"),
        F.lit(None).cast("double").alias("r2"), F.lit("saldo_cuenta").alias("top_feature"),
        F.lit(3).alias("best_k"), F.lit("").alias("distinctive"), F.col("reinforcement").alias("final_reward"),
        F.lit(0.2).alias("baseline")))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _report_sql() -> str:
    tgt = "replace(coalesce(target, 'la variable de interes'), '_', ' ')"
    top = "replace(coalesce(top_feature, 'el factor mas influyente'), '_', ' ')"
    imp = ("CASE WHEN task = 'clasificacion' THEN 'Anticipar casos de ''' || " + tgt + " || ''' con ' || "
           "CASE WHEN accuracy IS NOT NULL THEN printf('%.0f', accuracy * 100) || '% de aciertos' "
           "ELSE 'un desempeno solido' END || ' permite actuar antes de que ocurran, en lugar de reaccionar tarde.' "
           "ELSE 'Estimar ''' || " + tgt + " || ''' por adelantado ' || CASE WHEN r2 IS NOT NULL THEN "
           "'explicando el ' || printf('%.0f', r2 * 100) || '% de la variacion' ELSE 'con buena precision' END "
           "|| ' da margen para planificar con datos y no por intuicion.' END")
    perf = ("CASE WHEN final_reward IS NOT NULL AND baseline IS NOT NULL THEN 'acierta ' || "
            "printf('%.0f', final_reward * 100) || '% de las decisiones frente a ' || printf('%.0f', baseline * 100) "
            "|| '% al azar' ELSE 'supera a la decision al azar' END")
    vals = {"target": tgt, "top": top, "impacto_supervisado": imp, "k": "coalesce(CAST(best_k AS VARCHAR), 'varios')",
            "rasgos": "CASE WHEN coalesce(distinctive, '') <> '' THEN ' Rasgos que distinguen los grupos: ' || "
                      "distinctive || '.' ELSE '' END", "perf_refuerzo": perf}

    def fill(t: str) -> str:
        e = _q(t)
        for k, v in vals.items():
            e = f"replace({e}, '{{{k}}}', coalesce({v}, ''))"
        return e
    rows = []
    for w, recs in RT.TEMPLATES.items():
        for i, t in enumerate(recs):
            rows.append(f"SELECT case_id, {i + 1} AS position, " + ", ".join(
                f"{fill(x)} AS {f}" for x, f in zip(t, RT.FIELDS)) +
                f" FROM f WHERE (CASE WHEN winner IN ('unsupervised', 'reinforcement') THEN winner "
                f"ELSE 'supervised' END) = '{w}'")
    facts = """, f AS (SELECT r.case_id || ':' || r.goal AS case_id, r.approach AS winner, 'churn' AS target,
      'clasificacion' AS task, (SELECT score_norm FROM scores s WHERE s.case_id = r.case_id
        AND s.approach = 'supervised' AND s.status = 'ok') AS accuracy, CAST(NULL AS DOUBLE) AS r2,
      'saldo_cuenta' AS top_feature, 3 AS best_k, '' AS distinctive,
      (SELECT score_norm FROM scores s WHERE s.case_id = r.case_id AND s.approach = 'reinforcement'
        AND s.status = 'ok') AS final_reward, 0.2 AS baseline FROM rk r WHERE rank = 1) """
    return _CTES + facts + " UNION ALL ".join(rows)


@register("report_recommendations", _report_sql())
def q_report_recommendations(spark, sf):
    return RT.report_recommendations(_report_facts(spark, sf))


@register("report_json")
def q_report_json(spark, sf):
    """The full deterministic report per (segment, goal), validated with J7."""
    from ..operators import report as J
    facts = _report_facts(spark, sf)
    fin = derived(spark, sf, "finanzas")
    n_rows = fin.groupBy("segmento_cliente").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    finding = J.findings(J.class_balance(fin, "churn", ["segmento_cliente"]), None, "churn", "variable objetivo",
                         n_rows, ["segmento_cliente"])
    labels = F.create_map(*[x for g in V.GOALS for x in (F.lit(g), F.lit(V.GOAL_LABELS["finanzas"][g]))])
    wl = F.create_map(*[x for a, l in V.APPROACH_LABELS.items() for x in (F.lit(a), F.lit(l))])
    seg = F.split(F.col("case_id"), ":")
    facts = facts.withColumn("segmento_cliente", seg[0]).join(n_rows, "segmento_cliente").select(
        "*", F.lit(len(fin.columns)).alias("n_cols"), F.element_at(labels, seg[1]).alias("goal_label"),
        F.element_at(wl, F.col("winner")).alias("winner_label"), F.lit(V.DOMAIN_LABELS["finanzas"]).alias("domain_label"))
    finding = finding.join(facts.select("case_id", "segmento_cliente"), "segmento_cliente").select("case_id", "finding")
    rep = RT.report_json(facts, finding)
    return rep.select("case_id", "report", J.validate_report_json(F.col("report")).alias("is_valid"))
