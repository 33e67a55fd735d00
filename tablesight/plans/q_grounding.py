"""Checked queries for grounding of generated text (K1-K7).

Answers are the documents; the facts each answer may quote are per-source
statistics of the documents table (one fact table per source = context).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import grounding as K
from ..operators import texts as X
from .registry import register
from .tables import load, sql

_PAT = K.NUM_PATTERN
_EXTRACT_SQL = (f"SELECT doc_id, generate_subscripts(arr, 1) - 1 AS pos, unnest(arr) AS number FROM "
                f"(SELECT doc_id, regexp_extract_all(text, '{_PAT}') AS arr FROM documents)")


def _norm_sql(x: str) -> str:
    v = f"CAST(replace({x}, ',', '.') AS DOUBLE)"
    return (f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS HUGEINT) AS VARCHAR) "
            f"ELSE printf('%.1f', {v}) END")


def _norm_num_sql(x: str) -> str:
    return (f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS HUGEINT) AS VARCHAR) "
            f"ELSE printf('%.1f', {x}) END")


@register("extract_numbers", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, number FROM ({_EXTRACT_SQL})")
def q_extract_numbers(spark, sf):
    return K.extract_numbers(load(spark, sf, "documents"), "text", keep=["doc_id"])


@register("normalize_numbers", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, number, {_norm_sql('number')} AS norm "
          f"FROM ({_EXTRACT_SQL})")
def q_normalize_numbers(spark, sf):
    n = K.extract_numbers(load(spark, sf, "documents"), "text", keep=["doc_id"])
    return n.withColumn("norm", K.normalize_number(F.col("number")))


# Facts of each source (the context of its documents): counts and averages, plus a
# sentence that quotes numbers.
_FACTS_SQL = (
    "SELECT source AS context_id, CAST(count(*) AS DOUBLE) AS num_value, CAST(NULL AS STRING) AS str_value "
    "FROM documents GROUP BY source "
    "UNION ALL SELECT source, CAST(avg(n_chars) AS DOUBLE), CAST(NULL AS STRING) FROM documents GROUP BY source "
    "UNION ALL SELECT source, CAST(NULL AS DOUBLE), 'longest ' || CAST(max(n_chars) AS STRING) || ' chars, last doc ' "
    "|| CAST(max(doc_id) AS STRING) FROM documents GROUP BY source")

_ALLOWED_SQL = f"""WITH f AS ({_FACTS_SQL}),
a AS (SELECT context_id, {_norm_num_sql('num_value')} AS number FROM f WHERE num_value IS NOT NULL
      UNION SELECT context_id, {_norm_sql('m')} FROM
        (SELECT context_id, unnest(regexp_extract_all(str_value, '{_PAT}')) AS m FROM f WHERE str_value IS NOT NULL))"""


def _allowed(spark, sf):
    return K.allowed_numbers(sql(spark, sf, _FACTS_SQL, ("documents",)))


@register("allowed_numbers", _ALLOWED_SQL + " SELECT DISTINCT context_id, number FROM a")
def q_allowed_numbers(spark, sf):
    return _allowed(spark, sf)


@register("ungrounded_numbers", _ALLOWED_SQL + f""",
n AS (SELECT doc_id, source, {_norm_sql('number')} AS norm FROM
        (SELECT doc_id, source, unnest(regexp_extract_all(text, '{_PAT}')) AS number FROM documents)),
bad AS (SELECT doc_id, count(*) AS k FROM n WHERE norm NOT IN ('0', '1', '2', '3')
        AND NOT EXISTS (SELECT 1 FROM a WHERE a.context_id = n.source AND a.number = n.norm) GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS k FROM n GROUP BY doc_id)
SELECT d.doc_id AS answer_id, d.source AS context_id, CAST(coalesce(cnt.k, 0) AS BIGINT) AS n_numbers,
       CAST(coalesce(bad.k, 0) AS BIGINT) AS n_ungrounded, coalesce(bad.k, 0) = 0 AS valid
FROM documents d LEFT JOIN cnt ON d.doc_id = cnt.doc_id LEFT JOIN bad ON d.doc_id = bad.doc_id""")
def q_ungrounded_numbers(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"),
                                               F.col("source").alias("context_id"), "text")
    return K.ungrounded_numbers(docs, _allowed(spark, sf))


def _intent_sql(x: str) -> str:
    parts = []
    for topic, kws in K.INTENT_RULES:
        cond = " OR ".join(f"contains(lower({x}), '{k}')" for k in kws)
        parts.append(f"WHEN {cond} THEN '{topic}'")
    return "CASE " + " ".join(parts) + f" ELSE '{K.DEFAULT_INTENT}' END"


@register("question_intent", f"SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations "
          f"WHERE role = 'user' UNION ALL SELECT doc_id, -1, {_intent_sql('text')} FROM documents")
def q_question_intent(spark, sf):
    conv = load(spark, sf, "conversations").filter(F.col("role") == "user").select(
        "conv_id", "turn", K.question_intent(F.col("text")).alias("intent"))
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
                                               K.question_intent(F.col("text")).alias("intent"))
    return conv.unionByName(docs)


@register("cites_source", "SELECT doc_id, " + " OR ".join(
    f"contains(lower(text), '{k}')" for k in K.SOURCE_MARKERS) + " AS cites FROM documents")
def q_cites_source(spark, sf):
    return load(spark, sf, "documents").select("doc_id", K.cites_source(F.col("text")).alias("cites"))


# Facts of each language and one question per document: the keyword of one of the seven
# topics (or none), so that every template is filled.
_QA_FACTS = """SELECT lang AS context_id, CAST(count(*) AS BIGINT) AS filas, 5 AS columnas,
  CAST(count(DISTINCT source) AS BIGINT) AS numero_de_clusters,
  CAST(count(DISTINCT source) AS DOUBLE) / count(*) AS silhouette,
  max(source) AS enfoque_ganador, min(source) AS detalle_ganador, 'explorar' AS objetivo_de_negocio,
  CASE WHEN lang = 'en' THEN 'n_chars' END AS variable_mas_importante, 'Regresion Lineal' AS mejor_modelo,
  CAST(count(*) - count(DISTINCT text) AS DOUBLE) / count(*) AS acierto_final, CAST(1 AS DOUBLE) / count(DISTINCT source) AS acierto_al_azar,
  'revisar ' || min(source) AS siguiente_paso, CASE WHEN lang <> 'es' THEN 'predomina ' || max(source) END AS hallazgo_clave
FROM documents GROUP BY lang"""
_KEYWORDS = [kws[0] for _, kws in K.INTENT_RULES]
_QUESTION = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEYWORDS)) + " ELSE '' END || ' ' || text"


def _fill_sql(template: str) -> str:
    values = {"silhouette": "printf('%.2f', silhouette)", "acierto_final": "printf('%.0f', acierto_final * 100)",
              "acierto_al_azar": "printf('%.0f', acierto_al_azar * 100)"}
    e = "'" + template.replace("'", "''") + "'"
    for name in re.findall(r"[{]([a-z_]+)[}]", template):
        e = f"replace({e}, '{{{name}}}', coalesce(CAST({values.get(name, name)} AS VARCHAR), ''))"
    return e


def _asks(kws) -> str:
    return " OR ".join(f"contains(lower(question), '{k}')" for k in kws)


_NEEDS = dict(zip((t for t, _ in K.INTENT_RULES), ("enfoque_ganador", "variable_mas_importante", "filas", "numero_de_clusters",
                                                    "acierto_final", "siguiente_paso", "hallazgo_clave")))
_ANSWER_SQL = "CASE " + " ".join(f"WHEN ({_asks(kws)}) AND {_NEEDS[t]} IS NOT NULL THEN {_fill_sql(X.ANSWERS[t])}"
                                 for t, kws in K.INTENT_RULES) + " ELSE '" + X.ANSWER_DEFAULT.replace("'", "''") + "' END"
_ANSWERS_CTE = f"""qf AS ({_QA_FACTS}),
qs AS (SELECT doc_id, lang AS context_id, text, {_QUESTION} AS question FROM documents),
ans AS (SELECT qs.doc_id, qs.context_id, qs.text, {_ANSWER_SQL} AS answer FROM qs LEFT JOIN qf USING (context_id))"""
_CITES = " OR ".join(f"contains(lower(answer), '{k}')" for k in K.SOURCE_MARKERS)


def _answers(spark, sf):
    q = sql(spark, sf, f"SELECT doc_id, lang AS context_id, {_QUESTION} AS text FROM documents", ("documents",))
    return K.template_answers(q, sql(spark, sf, _QA_FACTS, ("documents",)))


@register("grounded_answers", f"WITH {_ANSWERS_CTE} SELECT doc_id, context_id, answer, {_CITES} AS cites FROM ans")
def q_grounded_answers(spark, sf):
    return _answers(spark, sf).select("doc_id", "context_id", "answer", K.cites_source(F.col("answer")).alias("cites"))


@register("gated_answers", _ALLOWED_SQL + f""", {_ANSWERS_CTE},
n AS (SELECT doc_id, source, {_norm_sql('number')} AS norm FROM
        (SELECT doc_id, source, unnest(regexp_extract_all(text, '{_PAT}')) AS number FROM documents)),
bad AS (SELECT DISTINCT doc_id FROM n WHERE norm NOT IN ('0', '1', '2', '3')
        AND NOT EXISTS (SELECT 1 FROM a WHERE a.context_id = n.source AND a.number = n.norm))
SELECT d.doc_id AS answer_id, d.source AS context_id, CASE WHEN bad.doc_id IS NULL AND trim(d.text) <> '' THEN d.text ELSE ans.answer END AS answer,
       bad.doc_id IS NULL AND trim(d.text) <> '' AS from_candidate
FROM documents d LEFT JOIN bad ON d.doc_id = bad.doc_id LEFT JOIN ans ON d.doc_id = ans.doc_id""")
def q_gated_answers(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("answer_id"), F.col("source").alias("context_id"), "text")
    templates = _answers(spark, sf).select(F.col("doc_id").alias("answer_id"), "answer")
    return K.gate_answers(docs, _allowed(spark, sf), templates)
