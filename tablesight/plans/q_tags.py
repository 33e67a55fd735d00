"""Checked queries for diagnosis rules and column tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tags as TG
from ..operators import vocabulary as V
from .q_profile import _kind_sql
from .registry import register
from .tables import DERIVED_COLUMNS, TABLES, derived, derived_duck, load

# Column type classes of the given tables (for generated oracle SQL).
TABLE_COLUMNS = {
    "region": [("r_regionkey", "numeric"), ("r_name", "string")],
    "nation": [("n_nationkey", "numeric"), ("n_name", "string"), ("n_regionkey", "numeric")],
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "numeric"), ("s_name", "string"), ("s_nationkey", "numeric"), ("s_acctbal", "numeric")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                 ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "datetime")],
    "events": [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
               ("event_type", "string"), ("value", "numeric"), ("props", "string")],
    "documents": [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "numeric")],
    "embeddings": [("vec_id", "numeric"), ("embedding", "string"), ("label", "numeric")],
    "pages": [("page_id", "numeric"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "numeric"), ("text", "string")],
    "labels": [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")],
    "conversations": [("conv_id", "numeric"), ("turn", "numeric"), ("role", "string"), ("text", "string")],
}
CATALOG_TABLES = {**DERIVED_COLUMNS, **{t: TABLE_COLUMNS[t] for t in TABLES}}
# Arrays are catalogued by their text, as in the profile.
_AS_TEXT = {"embeddings": "SELECT * REPLACE (CAST(embedding AS VARCHAR) AS embedding) FROM embeddings"}


def catalog(spark, sf):
    tables = {n: (derived(spark, sf, n) if n in DERIVED_COLUMNS else load(spark, sf, n))
              for n in CATALOG_TABLES}
    return TG.column_catalog(tables)


def names(spark, sf):
    """The catalogue of names and types of the same tables: schemas only, no scan."""
    return TG.name_catalog({n: (derived(spark, sf, n) if n in DERIVED_COLUMNS else load(spark, sf, n))
                            for n in CATALOG_TABLES})


def _sql_str(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _rules_values() -> str:
    rows = []
    for i, k in enumerate(V.TARGET_KEYWORDS):
        rows.append(("target", None, k, i, None))
    for d, kws in V.DOMAIN_KEYWORDS.items():
        rows += [("domain", d, k, i, None) for i, k in enumerate(kws)]
    for d, frames in V.TARGET_FRAMES.items():
        for fi, (frame, kws) in enumerate(frames):
            rows += [("frame", d, k, fi, frame) for k in kws]
    for rule, kws in (("money", V.MONEY_KEYWORDS), ("lat", V.LAT_KEYWORDS), ("lon", V.LON_KEYWORDS),
                      ("location", V.LOCATION_KEYWORDS), ("stock", V.STOCK_KEYWORDS),
                      ("delay", V.DELAY_KEYWORDS)):
        rows += [(rule, None, k, i, None) for i, k in enumerate(kws)]
    vals = ", ".join(f"({_sql_str(r)}, {_sql_str(d)}, {_sql_str(k)}, {p}, {_sql_str(f)})"
                     for r, d, k, p, f in rows)
    return f"rules(rule, domain, keyword, priority, frame) AS (VALUES {vals})"


def _catalog_sql() -> str:
    ctes = []
    parts = []
    for t, cols in CATALOG_TABLES.items():
        src = f"({derived_duck(t)})" if t in DERIVED_COLUMNS else f"({_AS_TEXT[t]})" if t in _AS_TEXT else t
        ctes.append(f"t_{t} AS (SELECT * FROM {src})")
        for i, (c, k) in enumerate(cols):
            tc = "string" if k == "string" else k
            parts.append(f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, "
                         f"{_kind_sql(c, k)} AS kind, '{tc}' AS type_class, count(*) AS n_rows, "
                         f"count(DISTINCT {c}) AS n_unique FROM t_{t}")
    return ("WITH " + ", ".join(ctes) + ", catalog AS (" + " UNION ALL ".join(parts) + "), "
            + _rules_values() + " ")


_TARGETS = """,
m AS (SELECT c.* FROM catalog c JOIN rules r ON r.rule = 'target' AND
      (CASE WHEN length(r.keyword) <= 2 THEN lower(trim(c.column_name)) = r.keyword
            ELSE contains(lower(c.column_name), r.keyword) OR lower(trim(c.column_name)) = r.keyword END)),
tgt AS (SELECT l.table_name, coalesce(f.kw_target, l.last_column) AS target_column
        FROM (SELECT table_name, arg_max(column_name, ordinal) AS last_column FROM catalog GROUP BY table_name) l
        LEFT JOIN (SELECT table_name, arg_min(column_name, ordinal) AS kw_target FROM m GROUP BY table_name) f
        USING (table_name)),
cat AS (SELECT *, type_class IN ('string', 'boolean')
          OR (n_unique <= greatest(10, floor(n_rows * 0.05)) AND n_unique <= 20) AS looks_categorical
        FROM catalog) """


@register("suggest_target", _catalog_sql() + _TARGETS + "SELECT table_name, target_column FROM tgt")
def q_suggest_target(spark, sf):
    return TG.suggest_target(names(spark, sf), V.rules_frame(spark))


@register("categorical_like", _catalog_sql() + _TARGETS +
          "SELECT table_name, column_name, looks_categorical FROM cat")
def q_categorical_like(spark, sf):
    return TG.categorical_like(catalog(spark, sf)).select("table_name", "column_name", "looks_categorical")


@register("applicable_analyses", _catalog_sql() + _TARGETS + """,
pt AS (SELECT table_name, max(n_rows) AS n_rows, sum(CASE WHEN kind = 'numeric' THEN 1 ELSE 0 END) AS n_numeric,
              sum(CASE WHEN kind = 'datetime' THEN 1 ELSE 0 END) AS n_datetime FROM cat GROUP BY table_name),
d AS (SELECT pt.*, tgt.target_column, cat.looks_categorical, cat.type_class,
        CASE WHEN tgt.target_column IS NOT NULL AND pt.n_rows >= 20 AND cat.looks_categorical THEN 'clasificacion'
             WHEN tgt.target_column IS NOT NULL AND pt.n_rows >= 20 AND cat.type_class = 'numeric' THEN 'regresion'
        END AS task
      FROM pt LEFT JOIN tgt USING (table_name)
      LEFT JOIN cat ON cat.table_name = pt.table_name AND cat.column_name = tgt.target_column)
SELECT table_name, target_column, CAST(n_rows AS BIGINT) AS n_rows, task IS NOT NULL AS supervised_ok, task,
       n_numeric >= 2 AND n_rows >= 20 AS unsupervised_ok, task IS NOT NULL AND n_rows >= 40 AS reinforcement_ok,
       n_datetime >= 1 AS has_temporal,
       concat_ws(',', CASE WHEN task IS NOT NULL THEN 'supervised' END,
                 CASE WHEN n_numeric >= 2 AND n_rows >= 20 THEN 'unsupervised' END,
                 CASE WHEN task IS NOT NULL AND n_rows >= 40 THEN 'reinforcement' END) AS applicable
FROM d""")
def q_applicable_analyses(spark, sf):
    # the targets need names only, so the profile of all tables is not planned again for them
    return TG.applicable_analyses(catalog(spark, sf), TG.suggest_target(names(spark, sf), V.rules_frame(spark)))


@register("domain_match", _catalog_sql() + """,
domains AS (SELECT DISTINCT domain FROM rules WHERE rule = 'domain' UNION SELECT 'general'),
hits AS (SELECT DISTINCT c.table_name, r.domain FROM catalog c JOIN rules r
         ON r.rule = 'domain' AND contains(lower(c.column_name), r.keyword))
SELECT t.table_name, d.domain,
       (h.domain IS NOT NULL) OR d.domain NOT IN (SELECT domain FROM rules WHERE rule = 'domain') AS domain_match
FROM (SELECT DISTINCT table_name FROM catalog) t CROSS JOIN domains d
LEFT JOIN hits h ON h.table_name = t.table_name AND h.domain = d.domain""")
def q_domain_match(spark, sf):
    return TG.domain_match(names(spark, sf), V.rules_frame(spark))


_PHRASES = ", ".join(f"('{d}', '{p}')" for d, p in V.TARGET_PHRASE.items())


@register("target_frame", _catalog_sql() + _TARGETS + f""",
phrases(domain, phrase) AS (VALUES {_PHRASES}),
g AS (SELECT * FROM tgt CROSS JOIN phrases),
hits AS (SELECT g.table_name, g.domain, arg_min(r.frame, r.priority) AS hit_frame FROM g JOIN rules r
         ON r.rule = 'frame' AND r.domain = g.domain AND contains(lower(g.target_column), r.keyword)
         GROUP BY g.table_name, g.domain)
SELECT g.table_name, g.domain, g.target_column, coalesce(h.hit_frame, g.phrase) AS target_frame
FROM g LEFT JOIN hits h ON h.table_name = g.table_name AND h.domain = g.domain""")
def q_target_frame(spark, sf):
    cat = names(spark, sf)
    rules = V.rules_frame(spark)
    return TG.target_frame(TG.suggest_target(cat, rules), rules)


_TAGS = """,
mm AS (SELECT c.*, r.rule FROM catalog c JOIN rules r
       ON r.rule IN ('money', 'lat', 'lon', 'stock', 'location', 'delay') AND contains(lower(c.column_name), r.keyword)),
tags AS (
  SELECT DISTINCT table_name, 'money' AS tag, column_name FROM mm WHERE rule = 'money' AND type_class = 'numeric'
  UNION ALL SELECT table_name, rule, arg_min(column_name, ordinal) FROM mm
    WHERE rule IN ('lat', 'lon', 'stock') AND type_class = 'numeric' GROUP BY table_name, rule
  UNION ALL SELECT table_name, rule, arg_min(column_name, ordinal) FROM mm
    WHERE rule = 'location' AND type_class <> 'numeric' GROUP BY table_name, rule
  UNION ALL SELECT table_name, rule, arg_min(column_name, ordinal) FROM mm
    WHERE rule = 'delay' GROUP BY table_name, rule) """


@register("column_tags", _catalog_sql() + _TAGS + "SELECT table_name, tag, column_name FROM tags")
def q_column_tags(spark, sf):
    return TG.column_tags(names(spark, sf), V.rules_frame(spark))


@register("logistics_availability", _catalog_sql() + _TAGS + """,
p AS (SELECT t.table_name,
        max(CASE WHEN tag = 'lat' THEN column_name END) AS lat_col,
        max(CASE WHEN tag = 'lon' THEN column_name END) AS lon_col,
        max(CASE WHEN tag = 'location' THEN column_name END) AS location_col,
        max(CASE WHEN tag = 'stock' THEN column_name END) AS stock_col,
        max(CASE WHEN tag = 'delay' THEN column_name END) AS delay_col
      FROM (SELECT DISTINCT table_name FROM catalog) t LEFT JOIN tags USING (table_name) GROUP BY t.table_name)
SELECT table_name, lat_col IS NOT NULL AND lon_col IS NOT NULL AS has_real_coords, lat_col, lon_col,
       location_col AS categorical_location_col, stock_col, delay_col,
       (lat_col IS NOT NULL AND lon_col IS NOT NULL) OR location_col IS NOT NULL AS map_possible,
       stock_col IS NOT NULL AS inventory_possible FROM p""")
def q_logistics_availability(spark, sf):
    cat = names(spark, sf)
    return TG.logistics_availability(cat, TG.column_tags(cat, V.rules_frame(spark)))


_GOALS = ", ".join(f"('{d}', '{g}', '{V.GOAL_LABELS[d][g]}')" for d in V.GOAL_LABELS for g in V.GOALS)


@register("goal_labels", _catalog_sql() + f""",
labels(domain, goal, goal_label) AS (VALUES {_GOALS}),
req AS (SELECT DISTINCT lower(trim(table_name)) AS req_domain, lower(kind) AS req_goal FROM catalog)
SELECT req_domain, req_goal, coalesce(ld.domain, 'general') AS eff_domain,
       coalesce(lg.goal, 'explorar') AS eff_goal, l.goal_label
FROM req LEFT JOIN (SELECT DISTINCT domain FROM labels) ld ON ld.domain = req.req_domain
LEFT JOIN (SELECT DISTINCT goal FROM labels) lg ON lg.goal = req.req_goal
LEFT JOIN labels l ON l.domain = coalesce(ld.domain, 'general') AND l.goal = coalesce(lg.goal, 'explorar')""")
def q_goal_labels(spark, sf):
    # Requests: each catalogued table asks for its name as domain and a column kind as goal,
    # which exercises both fallbacks (unknown domain -> general, unknown goal -> explorar).
    req = catalog(spark, sf).select(F.col("table_name").alias("domain"), F.col("kind").alias("goal")).distinct()
    out = TG.goal_labels(req, V.goal_labels_frame(spark))
    return out.select("req_domain", "req_goal", "eff_domain", "eff_goal", "goal_label")
