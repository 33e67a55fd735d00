"""Checked queries for profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import profile as P
from .registry import register
from .tables import DIRTY_EVENTS_SQL, dirty_events, load

EVENT_COLS = [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
              ("event_type", "string"), ("value", "numeric"), ("props", "string")]
DOC_COLS = [("doc_id", "numeric"), ("text", "string"), ("lang", "string"),
            ("source", "string"), ("n_chars", "numeric")]
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]


def _kind_sql(c: str, k: str) -> str:
    if k != "string":
        return f"CASE WHEN count({c}) = 0 THEN 'text' ELSE '{k}' END"
    return (
        f"CASE WHEN count({c}) = 0 THEN 'text' "
        f"WHEN avg(CASE WHEN try_cast({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) "
        f"FILTER (WHERE {c} IS NOT NULL) > 0.8 THEN 'datetime' "
        f"WHEN count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) / count({c}) > 0.5 "
        f"AND avg(length({c})) > 20 THEN 'text' ELSE 'categorical' END")


def profile_sql(src: str, cols) -> str:
    parts = []
    for i, (c, k) in enumerate(cols):
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, {_kind_sql(c, k)} AS kind, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
            f"CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) "
            f"ELSE 0.0::DOUBLE END AS pct_missing, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM src")
    return f"WITH src AS ({src}), prof AS ({' UNION ALL '.join(parts)}) "


PROFILE_COLS = ["ordinal", "column_name", "kind", "n_missing", "pct_missing", "n_unique"]


def _profile(df):
    return P.profile_columns(df, with_samples=False).select(
        F.col("ordinal").cast("long").alias("ordinal"), *PROFILE_COLS[1:])


@register("overview", f"""
WITH src AS ({DIRTY_EVENTS_SQL})
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_cols,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS BIGINT) AS n_duplicates,
       CAST(sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT
                + (event_type IS NULL)::INT + (value IS NULL)::INT + (props IS NULL)::INT) AS BIGINT)
         AS total_missing
FROM src""")
def q_overview(spark, sf):
    return P.overview(dirty_events(spark, sf))


@register("profile_columns", profile_sql(DIRTY_EVENTS_SQL, EVENT_COLS) + "SELECT * FROM prof")
def q_profile_columns(spark, sf):
    return round_doubles(_profile(dirty_events(spark, sf)))


@register("column_kinds",
          profile_sql("SELECT doc_id, text, lang, source, n_chars FROM documents", DOC_COLS)
          + "SELECT column_name, kind FROM prof")
def q_column_kinds(spark, sf):
    return P.profile_columns(load(spark, sf, "documents"), with_samples=False).select("column_name", "kind")


@register("kind_counts", profile_sql(DIRTY_EVENTS_SQL, EVENT_COLS) + """
SELECT kind, CAST(count(*) AS BIGINT) AS n_columns, string_agg(column_name, ',' ORDER BY ordinal) AS columns
FROM prof GROUP BY kind""")
def q_kind_counts(spark, sf):
    prof = P.profile_columns(dirty_events(spark, sf), with_samples=False)
    return P.kind_counts(prof).select("kind", "n_columns", F.array_join("columns", ",").alias("columns"))


@register("missing_ranking", profile_sql(DIRTY_EVENTS_SQL, EVENT_COLS) + """
, ranked AS (SELECT column_name, pct_missing, ordinal FROM prof WHERE pct_missing > 0
             UNION ALL SELECT '(sin nulos)', 0.0::DOUBLE, -1 WHERE NOT EXISTS (SELECT 1 FROM prof WHERE pct_missing > 0))
SELECT column_name, pct_missing, CAST(row_number() OVER (ORDER BY pct_missing DESC, ordinal) AS BIGINT) AS rank
FROM ranked""")
def q_missing_ranking(spark, sf):
    return round_doubles(P.missing_ranking(P.missing_counts(dirty_events(spark, sf))))


_SAMPLE_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


# Spark prints a timestamp without trailing zeros of the fraction.
_TS_TEXT = "regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '[.]$', '')"


def _sample_sql() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, {_TS_TEXT if c == 'ts' else f'CAST({c} AS VARCHAR)'} AS v, row_number() OVER (ORDER BY {c}) AS rn "
        f"FROM (SELECT DISTINCT {c} FROM src WHERE {c} IS NOT NULL)" for c in _SAMPLE_COLS]
    return (f"WITH src AS ({DIRTY_EVENTS_SQL}) SELECT column_name, string_agg(v, '|' ORDER BY rn) AS samples "
            f"FROM ({' UNION ALL '.join(parts)}) WHERE rn <= 5 GROUP BY column_name")


@register("sample_values", _sample_sql())
def q_sample_values(spark, sf):
    df = dirty_events(spark, sf).select(*_SAMPLE_COLS)
    return P.sample_values(df).select("column_name", F.array_join("sample_values", "|").alias("samples"))


@register("duplicate_count", f"""
WITH src AS ({DIRTY_EVENTS_SQL})
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS n FROM src GROUP BY ALL_COLUMNS_PLACEHOLDER)""".replace(
    "ALL_COLUMNS_PLACEHOLDER", "event_id, ts, user_id, event_type, value, props"))
def q_duplicate_count(spark, sf):
    return P.duplicate_count(dirty_events(spark, sf))


def _iqr_sql() -> str:
    parts = []
    for i, c in enumerate(LINEITEM_NUM):
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, q1, q3,
  q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
  (SELECT CAST(count(*) AS BIGINT) FROM lineitem
    WHERE q3 - q1 <> 0 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
      FROM lineitem)""")
    body = " UNION ALL ".join(parts)
    return (f"SELECT ordinal, column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, "
            f"round(upper, 6) AS upper, n_outliers FROM ({body})")


@register("iqr_outliers", _iqr_sql())
def q_iqr_outliers(spark, sf):
    out = P.iqr_outliers(load(spark, sf, "lineitem"), LINEITEM_NUM)
    return round_doubles(out.withColumn("ordinal", F.col("ordinal").cast("long")))


@register("preview_topk", """
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer
ORDER BY c_custkey LIMIT 10""")
def q_preview_topk(spark, sf):
    from ..sources.readers import preview
    return round_doubles(preview(load(spark, sf, "customer"), ["c_custkey"]))
