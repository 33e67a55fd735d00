"""Checked queries for report facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import report as J
from .registry import register
from .tables import load, sql

G = ["o_orderpriority"]


@register("target_stats", """
SELECT o_orderpriority, round(avg(o_totalprice), 2) AS media, round(median(o_totalprice), 2) AS mediana,
       round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, CAST(count(*) AS BIGINT) AS n_rows
FROM orders GROUP BY o_orderpriority""")
def q_target_stats(spark, sf):
    return round_doubles(J.target_stats(load(spark, sf, "orders"), "o_totalprice", G))


_COUNTS = """c AS (SELECT o_orderpriority, o_orderstatus AS value, count(*) AS n FROM orders
       WHERE o_orderstatus IS NOT NULL GROUP BY o_orderpriority, o_orderstatus),
p AS (SELECT *, round(n * 100.0 / sum(n) OVER (PARTITION BY o_orderpriority), 1) AS pct,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, value) AS rank FROM c)"""


@register("target_distribution", f"""WITH {_COUNTS}
SELECT o_orderpriority, value, CAST(n AS BIGINT) AS n, pct, CAST(rank AS BIGINT) AS rank FROM p WHERE rank <= 6""")
def q_target_distribution(spark, sf):
    return round_doubles(J.target_distribution(load(spark, sf, "orders"), "o_orderstatus", G))


@register("frequent_event_types", """
SELECT value, n, round(n * 100.0 / sum(n) OVER (), 1) AS pct, row_number() OVER (ORDER BY n DESC, value) AS rank
FROM (SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type)
QUALIFY rank <= 6""")
def q_frequent_event_types(spark, sf):
    """J2 of a whole table: the candidates of a sketch, counted."""
    return round_doubles(J.target_distribution(load(spark, sf, "events"), "event_type"))


@register("frequent_customers", """
SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(o_custkey) FROM orders), 1) AS pct,
       row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) AS rank
FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey QUALIFY rank <= 6""")
def q_frequent_customers(spark, sf):
    """J2 of a column of many values, none of which stands out."""
    return round_doubles(J.target_distribution(load(spark, sf, "orders"), "o_custkey"))


_BAL = f"""{_COUNTS},
b AS (SELECT o_orderpriority, arg_min(value, rank) AS majority, arg_min(pct, rank) AS majority_pct,
             arg_max(value, rank) AS minority, arg_max(pct, rank) AS minority_pct FROM
        (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n ASC, value) AS rank_min FROM p) x
      GROUP BY o_orderpriority)"""
# minority = smallest count, smallest value on ties (rank_min = 1)
_BAL = _BAL.replace("arg_max(value, rank) AS minority, arg_max(pct, rank) AS minority_pct",
                    "arg_min(value, rank_min) AS minority, arg_min(pct, rank_min) AS minority_pct")


@register("class_balance", f"WITH {_BAL} SELECT * FROM b")
def q_class_balance(spark, sf):
    return round_doubles(J.class_balance(load(spark, sf, "orders"), "o_orderstatus", G))


@register("facts_table", f"""WITH {_BAL},
st AS (SELECT o_orderpriority, round(avg(o_totalprice), 2) AS media, round(median(o_totalprice), 2) AS mediana,
              round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, count(*) AS n_rows
       FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, 'clase' AS section, 'majority' AS key, CAST(NULL AS DOUBLE) AS num_value, majority AS str_value FROM b
UNION ALL SELECT o_orderpriority, 'clase', 'majority_pct', majority_pct, NULL FROM b
UNION ALL SELECT o_orderpriority, 'clase', 'minority', NULL, minority FROM b
UNION ALL SELECT o_orderpriority, 'clase', 'minority_pct', minority_pct, NULL FROM b
UNION ALL SELECT o_orderpriority, 'distribucion', 'media', media, NULL FROM st
UNION ALL SELECT o_orderpriority, 'distribucion', 'mediana', mediana, NULL FROM st
UNION ALL SELECT o_orderpriority, 'distribucion', 'min', min, NULL FROM st
UNION ALL SELECT o_orderpriority, 'distribucion', 'max', max, NULL FROM st
UNION ALL SELECT o_orderpriority, 'distribucion', 'n_rows', n_rows, NULL FROM st""")
def q_facts_table(spark, sf):
    o = load(spark, sf, "orders")
    bal = J.facts_long(J.class_balance(o, "o_orderstatus", G), "clase",
                       ["majority", "majority_pct", "minority", "minority_pct"], G)
    st = J.facts_long(J.target_stats(o, "o_totalprice", G), "distribucion",
                      ["media", "mediana", "min", "max", "n_rows"], G)
    return round_doubles(bal.unionByName(st))


@register("findings_by_group", f"""WITH {_BAL},
nr AS (SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY o_orderpriority)
SELECT nr.o_orderpriority,
  'En ''o orderstatus'' (marco de referencia: variable objetivo), el valor mas frecuente es ''' || majority || ''' con '
  || CAST(majority_pct AS VARCHAR) || '% de los ' || CAST(n_rows AS VARCHAR) || ' registros analizados.'
  || CASE WHEN minority <> majority THEN ' El grupo menos representado (''' || minority || ''') concentra solo '
          || CAST(minority_pct AS VARCHAR) || '%, lo que marca un desbalance a vigilar.' ELSE '' END AS finding
FROM nr JOIN b ON nr.o_orderpriority = b.o_orderpriority""")
def q_findings_by_group(spark, sf):
    o = load(spark, sf, "orders")
    n = o.groupBy(*G).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return J.findings(J.class_balance(o, "o_orderstatus", G), None, "o_orderstatus", "variable objetivo", n, G)


_TXT = "regexp_replace(printf('%.2f', {}), '0$', '')"


@register("findings_continuous", f"""SELECT o_orderpriority,
  'En ''o totalprice'', el valor promedio es ' || {_TXT.format('round(avg(o_totalprice), 2)')} || ' (mediana '
  || {_TXT.format('round(median(o_totalprice), 2)')} || '), con un rango que va de ' || {_TXT.format('round(min(o_totalprice), 2)')}
  || ' a ' || {_TXT.format('round(max(o_totalprice) * 1000, 2)')} || ' en los ' || CAST(count(*) AS VARCHAR) || ' registros analizados.' AS finding
FROM orders GROUP BY o_orderpriority""")
def q_findings_continuous(spark, sf):
    # the maximum is shown in thousandths, so that numbers of eight digits occur
    o = load(spark, sf, "orders")
    n = o.groupBy(*G).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    stats = J.target_stats(o, "o_totalprice", G)
    large = J.target_stats(o.withColumn("o_totalprice", F.col("o_totalprice") * 1000), "o_totalprice", G).select(*G, F.col("max").alias("big"))
    stats = stats.join(large, G).withColumn("max", F.col("big")).drop("big")
    return J.findings(None, stats, "o_totalprice", None, n, G)


@register("findings_neutral", """SELECT o_orderpriority, 'Se analizaron ' || CAST(count(*) AS VARCHAR)
  || ' registros sobre ''o comment''; los datos quedaron completos y listos para decidir.' AS finding
FROM orders GROUP BY o_orderpriority""")
def q_findings_neutral(spark, sf):
    o = load(spark, sf, "orders").withColumn("o_comment", F.lit(None).cast("string"))
    n = o.groupBy(*G).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return J.findings(J.class_balance(o, "o_comment", G), None, "o_comment", None, n, G)


_REC = ('{"titulo": "t", "descripcion": "d", "impacto_esperado": "i", "riesgo_o_consideracion": "r"}')
_REC_BAD = '{"titulo": "t", "descripcion": "d", "impacto_esperado": "i"}'
_JSON_SQL = (
    "SELECT c_custkey, CASE c_custkey % 4 "
    f"WHEN 0 THEN '{{\"titulo\": \"' || c_mktsegment || '\", \"resumen_situacion\": \"s\", \"hallazgo_clave\": \"h\", "
    f"\"recomendaciones\": [{_REC}, {_REC}, {_REC}], \"siguiente_paso_sugerido\": \"p\"}}' "
    f"WHEN 1 THEN '{{\"titulo\": \"' || c_mktsegment || '\", \"resumen_situacion\": \"s\", "
    f"\"recomendaciones\": [{_REC}, {_REC}, {_REC}], \"siguiente_paso_sugerido\": \"p\"}}' "
    f"WHEN 2 THEN '{{\"titulo\": \"' || c_mktsegment || '\", \"resumen_situacion\": \"s\", \"hallazgo_clave\": \"h\", "
    f"\"recomendaciones\": [{_REC}, {_REC}], \"siguiente_paso_sugerido\": \"p\"}}' "
    f"ELSE '{{\"titulo\": \"' || c_mktsegment || '\", \"resumen_situacion\": \"s\", \"hallazgo_clave\": \"h\", "
    f"\"recomendaciones\": [{_REC}, {_REC_BAD}, {_REC}], \"siguiente_paso_sugerido\": \"p\"}}' END AS report "
    "FROM customer")

_KEYS_OK = " AND ".join(f"json_exists(report, '$.{k}')" for k in J.REPORT_KEYS)
_RECS_OK = " AND ".join(f"json_exists(report, '$.recomendaciones[{i}].{f}')" for i in range(3) for f in J.REC_FIELDS)


@register("validate_report_json", f"""
SELECT c_custkey, coalesce({_KEYS_OK} AND json_array_length(report, '$.recomendaciones') = 3 AND {_RECS_OK}, false)
       AS is_valid FROM ({_JSON_SQL})""")
def q_validate_report_json(spark, sf):
    df = sql(spark, sf, _JSON_SQL, ("customer",))
    return df.select("c_custkey", J.validate_report_json(F.col("report")).alias("is_valid"))
