"""Checked queries for what-if scenarios and the BCG matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import scenario as N
from ..operators import supervised as S
from .registry import register
from .tables import derived, derived_duck, load

TARGET = "ventas_trimestre"
_EST = f"est AS ({derived_duck('estrategia')})"
_NUM = ["registro_id", "inversion_marketing", "antiguedad_meses", "segmento_alto_valor"]
_BASE_SQL = (f"base AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in _NUM)
             + ", (SELECT region FROM est WHERE region IS NOT NULL GROUP BY region ORDER BY count(*) DESC, region "
             "LIMIT 1) AS region FROM est)")
# Scenarios derived from the data: "what if marketing investment were each region's mean",
# plus an override of a column the model does not know (ignored).
_SCEN_SPARK = ("SELECT region AS scenario, 'inversion_marketing' AS column_name, avg(inversion_marketing) AS value "
               "FROM est GROUP BY region UNION ALL SELECT region, 'columna_inexistente', 1.0 FROM est GROUP BY region")


def _est(spark, sf):
    est = derived(spark, sf, "estrategia")
    est.createOrReplaceTempView("est")
    return est


def _baseline(spark, sf):
    return N.baseline_row(_est(spark, sf), TARGET).select(*_NUM, "region")


def _scenarios(spark, sf):
    _est(spark, sf)
    return N.scenario_rows(_baseline(spark, sf), spark.sql(_SCEN_SPARK))


@register("baseline_row", f"WITH {_EST}, {_BASE_SQL} SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _NUM) + ", region FROM base")
def q_baseline_row(spark, sf):
    return round_doubles(_baseline(spark, sf))


@register("scenario_rows", f"WITH {_EST}, {_BASE_SQL}, scen AS ({_SCEN_SPARK}), ids AS (SELECT DISTINCT scenario FROM scen) "
          "SELECT ids.scenario, " + ", ".join(
              f"round(coalesce((SELECT value FROM scen s WHERE s.scenario = ids.scenario AND s.column_name = '{c}'), "
              f"base.{c}), 6) AS {c}" for c in _NUM) + ", base.region FROM ids, base")
def q_scenario_rows(spark, sf):
    return round_doubles(_scenarios(spark, sf))


_GRID_COLS = ["inversion_marketing", "antiguedad_meses"]


@register("scenario_grid", f"WITH {_EST}, mm AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) AS mn, max({c}) AS mx FROM est" for c in _GRID_COLS) + """)
SELECT column_name, round(mn, 6) AS min, round(mx, 6) AS max, CAST(step AS INTEGER) AS step,
       round(mn + (mx - mn) * step / 10, 6) AS value FROM mm, range(0, 11) t(step)""")
def q_scenario_grid(spark, sf):
    return round_doubles(N.scenario_grid(_est(spark, sf), _GRID_COLS))


@register("latest_scenarios", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
       AS recency FROM orders QUALIFY recency <= 3""")
def q_latest_scenarios(spark, sf):
    o = load(spark, sf, "orders")
    return N.latest(o, "o_orderdate", "o_orderkey", group_by=["o_custkey"]).select("o_custkey", "o_orderkey", "recency")


_BCG_SQL = f"""WITH {_EST},
o AS (SELECT avg(inversion_marketing) AS x_mid, avg(ventas_trimestre) AS y_mid FROM est),
per AS (SELECT region AS cluster, avg(inversion_marketing) AS x, avg(ventas_trimestre) AS y, count(*) AS size
        FROM est GROUP BY region),
q AS (SELECT cluster, CASE WHEN x >= x_mid AND y >= y_mid THEN 'Estrella' WHEN x >= x_mid THEN 'Vaca lechera'
                            WHEN y >= y_mid THEN 'Interrogante' ELSE 'Perro' END AS label,
             x, y, CAST(size AS BIGINT) AS size, x_mid, y_mid FROM per, o)"""


def _bcg(spark, sf):
    return N.bcg_quadrants(_est(spark, sf), "region", "inversion_marketing", TARGET)


@register("bcg_quadrants", _BCG_SQL + """
SELECT cluster, label, round(x, 6) AS x, round(y, 6) AS y, size, round(x_mid, 6) AS x_mid, round(y_mid, 6) AS y_mid
FROM q""")
def q_bcg_quadrants(spark, sf):
    return round_doubles(_bcg(spark, sf))


@register("bcg_summary", _BCG_SQL + """
SELECT CAST(row_number() OVER (ORDER BY size DESC, cluster) AS BIGINT) AS position,
       printf('Cluster %s (%d registros) es ''%s'': %s=%.2f, %s=%.2f.', cluster, size, label, 'inversion_marketing', x,
              'ventas_trimestre', y) AS line FROM q""")
def q_bcg_summary(spark, sf):
    return N.bcg_summary(_bcg(spark, sf), "inversion_marketing", TARGET)


@register("bcg_layout", _BCG_SQL + """
SELECT cluster, label, round(x, 6) AS x, round(y, 6) AS y,
       round(greatest(20, least(70, sqrt(greatest(size, 1)) * 8)), 6) AS bubble,
       round(avg(x) OVER (), 6) AS plot_x_mid, round(avg(y) OVER (), 6) AS plot_y_mid FROM q""")
def q_bcg_layout(spark, sf):
    return round_doubles(N.bcg_layout(_bcg(spark, sf)))


@register("score_scenarios")
def q_score_scenarios(spark, sf):
    est = _est(spark, sf)
    res = S.train_and_select(est, TARGET, "registro_id", candidates=["Regresion Lineal"])
    rows = _scenarios(spark, sf)
    return N.score_scenarios(res.model, res.encoder, rows).select("scenario", "raw_prediction")


@register("scenario_probabilities")
def q_scenario_probabilities(spark, sf):
    est = _est(spark, sf).drop(TARGET)
    target = "segmento_alto_valor"
    res = S.train_and_select(est, target, "registro_id", candidates=["Regresion Logistica"])
    base = N.baseline_row(est, target)
    rows = N.scenario_rows(base, spark.sql(_SCEN_SPARK))
    labels = res.target_encoding.labels
    scored = N.score_scenarios(res.model, res.encoder, rows, labels)
    return N.scenario_probabilities(scored, labels)
