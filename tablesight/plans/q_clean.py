"""Checked queries for cleaning."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.columns import adjusted_skew, col, ntz_micros, round_doubles
from ..functions.ordered import fill_forward_backward
from ..operators import profile as P
from ..operators import tags as TG
from ..operators import texts as X
from ..operators import vocabulary as V
from ..operators.clean import CleaningPlan, cleaning_sentences, coerce_numeric, dedupe_rows
from .registry import register
from .tables import (DIRTY_EVENTS_SQL, GAPPY_DOCUMENTS_SQL, GAPPY_EVENTS_SQL, dirty_events,
                     gappy_documents, gappy_events, load, sql)

EVENT_OUT = ["event_id", "ts_us", "user_id", "event_type", "value", "props"]
LINE_VALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]


def _events_out(df):
    return round_doubles(df.select(
        F.col("event_id").cast("double").alias("event_id"), ntz_micros("ts").alias("ts_us"),
        F.col("user_id").cast("double").alias("user_id"), "event_type",
        F.col("value").cast("double").alias("value"), "props"))


def _clip_ctes(rel: str, cols: list[str]) -> str:
    """CTEs q_<rel> (quartiles) and c_<rel> (clip counts) for ``cols`` of relation ``rel``."""
    qs = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{i}, "
                   f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{i}" for i, c in enumerate(cols))
    cs = ", ".join(f"sum(CASE WHEN q3_{i} - q1_{i} <> 0 AND ({c} < q1_{i} - 1.5 * (q3_{i} - q1_{i}) "
                   f"OR {c} > q3_{i} + 1.5 * (q3_{i} - q1_{i})) THEN 1 ELSE 0 END) AS n_{i}"
                   for i, c in enumerate(cols))
    return f"q_{rel} AS (SELECT {qs} FROM {rel}), c_{rel} AS (SELECT {cs} FROM {rel}, q_{rel})"


def _clip_expr(c: str, i: int) -> str:
    return (f"CASE WHEN q3_{i} - q1_{i} = 0 THEN CAST({c} AS DOUBLE) ELSE "
            f"least(greatest(CAST({c} AS DOUBLE), q1_{i} - 1.5 * (q3_{i} - q1_{i})), "
            f"q3_{i} + 1.5 * (q3_{i} - q1_{i})) END")


EV_NUM = ["event_id", "user_id", "value"]
# Dirty events: dedupe, impute (value: mean/median by skew, event_type: mode), clip numerics.
_EVENTS_CLEAN_CTES = f"""
WITH src AS ({DIRTY_EVENTS_SQL}),
d AS (SELECT DISTINCT * FROM src),
st AS (SELECT abs(skewness(value)) AS sk, median(value) AS med, avg(value) AS mean FROM d),
md AS (SELECT event_type AS m FROM d WHERE event_type IS NOT NULL GROUP BY event_type
       ORDER BY count(*) DESC, event_type LIMIT 1),
imp AS (SELECT event_id, ts, user_id, coalesce(event_type, (SELECT m FROM md)) AS event_type,
        coalesce(value, (SELECT CASE WHEN sk > 1 THEN med ELSE mean END FROM st)) AS value, props FROM d),
{_clip_ctes('imp', EV_NUM)}"""


@register("dedupe_rows", f"""
SELECT CAST(event_id AS DOUBLE) AS event_id, epoch_us(ts) AS ts_us, CAST(user_id AS DOUBLE) AS user_id,
       event_type, round(value, 6) AS value, props
FROM (SELECT DISTINCT * FROM ({DIRTY_EVENTS_SQL}))""")
def q_dedupe_rows(spark, sf):
    return _events_out(dedupe_rows(dirty_events(spark, sf)))


_SPARSE_SQL = ("SELECT event_id, event_type, value, CASE WHEN event_id % 3 <> 0 THEN NULL ELSE props END AS "
               "sparse_props, CASE WHEN event_id % 5 < 3 THEN NULL ELSE user_id END AS half_user FROM events")


@register("drop_sparse_columns", f"""
WITH src AS ({_SPARSE_SQL}),
p AS (SELECT 'event_id' AS column_name, 0 AS o, count(*) - count(event_id) AS m, count(*) AS n FROM src
      UNION ALL SELECT 'event_type', 1, count(*) - count(event_type), count(*) FROM src
      UNION ALL SELECT 'value', 2, count(*) - count(value), count(*) FROM src
      UNION ALL SELECT 'sparse_props', 3, count(*) - count(sparse_props), count(*) FROM src
      UNION ALL SELECT 'half_user', 4, count(*) - count(half_user), count(*) FROM src)
SELECT column_name, round(100.0::DOUBLE * m / n, 2) AS pct_missing, round(100.0::DOUBLE * m / n, 2) < 60 AS kept
FROM p""")
def q_drop_sparse_columns(spark, sf):
    from ..operators.clean import drop_sparse_columns
    df = sql(spark, sf, _SPARSE_SQL, ("events",))
    prof = P.profile_columns(df, with_samples=False)
    kept = set(drop_sparse_columns(df, profile=prof).columns)
    kept_df = spark.createDataFrame([(c,) for c in kept], "column_name string")
    return (prof.select("column_name", "pct_missing")
            .join(kept_df.withColumn("kept", F.lit(True)), "column_name", "left")
            .select("column_name", "pct_missing", F.coalesce("kept", F.lit(False)).alias("kept")))


_SKEW_COLS = LINE_VALS + ["l_linenumber"]


@register("skewness_adjusted", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(coalesce(skewness(CAST({c} AS DOUBLE)), 0), 6) AS skew FROM lineitem"
    for c in _SKEW_COLS))
def q_skewness_adjusted(spark, sf):
    li = load(spark, sf, "lineitem")
    row = li.agg(*[adjusted_skew(col(c).cast("double")).alias(c) for c in _SKEW_COLS])
    return round_doubles(row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("skew")) for c in _SKEW_COLS]))))


@register("impute_numeric", _EVENTS_CLEAN_CTES + """
SELECT 'value' AS column_name, round(sk, 6) AS abs_skew,
       CASE WHEN sk > 1 THEN 'mediana' ELSE 'media' END AS method,
       round(CASE WHEN sk > 1 THEN med ELSE mean END, 6) AS fill_value FROM st""")
def q_impute_numeric(spark, sf):
    plan = CleaningPlan.fit(dirty_events(spark, sf), order_by=["event_id"])
    rows = [(c, plan.skew[c], m, float(v)) for c, (m, v) in plan.impute.items() if c in plan.skew]
    return round_doubles(spark.createDataFrame(
        rows, "column_name string, abs_skew double, method string, fill_value double"))


@register("impute_mode", _EVENTS_CLEAN_CTES + """
SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM imp GROUP BY event_type""")
def q_impute_mode(spark, sf):
    raw = dirty_events(spark, sf)
    plan = CleaningPlan.fit(raw, order_by=["event_id"])
    return plan.transform(raw).groupBy("event_type").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("fill_forward_backward", f"""
SELECT event_id, epoch_us(coalesce(
  last_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))
  AS ts_us
FROM ({GAPPY_EVENTS_SQL})""")
def q_fill_forward_backward(spark, sf):
    df = gappy_events(spark, sf).select("event_id", "ts")
    filled = fill_forward_backward(df, ["ts"], ["event_id"])
    return filled.select("event_id", ntz_micros("ts").alias("ts_us"))


# A group with a third of the rows, a group without a key, and the groups of the users.
_GROUPED_EVENTS = (f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id % 50 = 1 THEN NULL ELSE user_id % 40 END AS grp, "
                   f"CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS value, ts FROM ({GAPPY_EVENTS_SQL})")


@register("fill_by_group", f"""
SELECT event_id, grp, round(coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY grp ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY grp ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value,
  epoch_us(coalesce(
  last_value(ts IGNORE NULLS) OVER (PARTITION BY grp ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(ts IGNORE NULLS) OVER (PARTITION BY grp ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS ts_us
FROM ({_GROUPED_EVENTS})""")
def q_fill_by_group(spark, sf):
    df = sql(spark, sf, _GROUPED_EVENTS, ("events",))
    filled = fill_forward_backward(df, ["value", "ts"], ["event_id"], partition_by=["grp"])
    return round_doubles(filled.select("event_id", "grp", "value", ntz_micros("ts").alias("ts_us")))


@register("impute_text", f"""
SELECT doc_id, md5(coalesce(text, 'desconocido')) AS text_md5, text IS NULL AS was_missing
FROM ({GAPPY_DOCUMENTS_SQL})""")
def q_impute_text(spark, sf):
    raw = gappy_documents(spark, sf)
    plan = CleaningPlan.fit(raw, order_by=["doc_id"])
    out = plan.transform(raw)
    return out.join(raw.select("doc_id", F.col("text").isNull().alias("was_missing")), "doc_id") \
              .select("doc_id", F.md5("text").alias("text_md5"), "was_missing")


_LINE_CLEAN_CTES = f"""
WITH imp AS (SELECT {', '.join(LINE_KEYS + LINE_VALS)} FROM lineitem), {_clip_ctes('imp', LINE_VALS)}"""


@register("winsorize_iqr", _LINE_CLEAN_CTES + f"""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
{', '.join(f'round({_clip_expr(c, i)}, 6) AS {c}' for i, c in enumerate(LINE_VALS))}
FROM imp, q_imp""")
def q_winsorize_iqr(spark, sf):
    li = load(spark, sf, "lineitem").select(*LINE_KEYS, *LINE_VALS)
    plan = CleaningPlan.fit(li, exclude_from_clip=LINE_KEYS)
    out = plan.transform(li, dedupe=False)
    return round_doubles(out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                                    *[F.col(c).cast("double").alias(c) for c in LINE_VALS]))


@register("winsorize_counts", _EVENTS_CLEAN_CTES + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(q1_{i} - 1.5 * (q3_{i} - q1_{i}), 6) AS lower, "
    f"round(q3_{i} + 1.5 * (q3_{i} - q1_{i}), 6) AS upper, CAST(n_{i} AS BIGINT) AS n_clipped "
    f"FROM q_imp, c_imp" for i, c in enumerate(EV_NUM)) + ") WHERE n_clipped > 0")
def q_winsorize_counts(spark, sf):
    plan = CleaningPlan.fit(dirty_events(spark, sf), order_by=["event_id"])
    rows = [(c, lo, hi, n) for c, (lo, hi, n) in plan.clip.items()]
    return round_doubles(spark.createDataFrame(
        rows, "column_name string, lower double, upper double, n_clipped long"))


_PLAN_SQL = _EVENTS_CLEAN_CTES + """,
rows AS (
  SELECT 0 AS sec, 3 AS o, 'event_type' AS column_name, 'categorical' AS kind, 'moda' AS action,
         NULL::DOUBLE AS num_value, (SELECT m FROM md) AS str_value
  UNION ALL
  SELECT 0, 4, 'value', 'numeric', CASE WHEN sk > 1 THEN 'mediana' ELSE 'media' END,
         CASE WHEN sk > 1 THEN med ELSE mean END, NULL FROM st
  UNION ALL
  SELECT 2, 0, NULL, NULL, 'eliminar duplicados', (SELECT count(*) FROM src) - (SELECT count(*) FROM d), NULL
  UNION ALL SELECT 3, 0, 'event_id', 'numeric', 'winsorizar', n_0, NULL FROM c_imp WHERE n_0 > 0
  UNION ALL SELECT 3, 2, 'user_id', 'numeric', 'winsorizar', n_1, NULL FROM c_imp WHERE n_1 > 0
  UNION ALL SELECT 3, 4, 'value', 'numeric', 'winsorizar', n_2, NULL FROM c_imp WHERE n_2 > 0)
SELECT CAST(row_number() OVER (ORDER BY sec, o) - 1 AS INTEGER) AS step, column_name, kind, action,
       round(CAST(num_value AS DOUBLE), 6) AS num_value, str_value FROM rows"""


@register("cleaning_plan", _PLAN_SQL)
def q_cleaning_plan(spark, sf):
    plan = CleaningPlan.fit(dirty_events(spark, sf), order_by=["event_id"])
    return round_doubles(plan.plan_table(spark))


_REPORT_SQL = _EVENTS_CLEAN_CTES + """,
cl AS (SELECT event_id, user_id, value FROM imp),
rows AS (
  SELECT 'overview_before' AS section, 'n_rows' AS key, CAST((SELECT count(*) FROM src) AS DOUBLE) AS num_value,
         NULL AS str_value
  UNION ALL SELECT 'overview_before', 'n_cols', 6, NULL
  UNION ALL SELECT 'overview_before', 'n_duplicates', (SELECT count(*) FROM src) - (SELECT count(*) FROM d), NULL
  UNION ALL SELECT 'overview_before', 'total_missing', (SELECT 6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type)
    - count(value) - count(props) FROM src), NULL
  UNION ALL SELECT 'overview_after', 'n_rows', (SELECT count(*) FROM d), NULL
  UNION ALL SELECT 'overview_after', 'n_cols', 6, NULL
  UNION ALL SELECT 'overview_after', 'n_duplicates', 0, NULL
  UNION ALL SELECT 'overview_after', 'total_missing', 0, NULL
  UNION ALL SELECT 'duplicates_removed', 'rows', (SELECT count(*) FROM src) - (SELECT count(*) FROM d), NULL
  UNION ALL SELECT 'imputed', 'event_type', NULL, 'moda'
  UNION ALL SELECT 'imputed', 'value', NULL, CASE WHEN sk > 1 THEN 'mediana' ELSE 'media' END FROM st
  UNION ALL SELECT 'winsorized', 'event_id', n_0, NULL FROM c_imp WHERE n_0 > 0
  UNION ALL SELECT 'winsorized', 'user_id', n_1, NULL FROM c_imp WHERE n_1 > 0
  UNION ALL SELECT 'winsorized', 'value', n_2, NULL FROM c_imp WHERE n_2 > 0)
SELECT section, key, CAST(num_value AS DOUBLE) AS num_value, str_value FROM rows"""


@register("cleaning_report", _REPORT_SQL)
def q_cleaning_report(spark, sf):
    raw = dirty_events(spark, sf)
    plan = CleaningPlan.fit(raw, order_by=["event_id"])
    return round_doubles(plan.report_table(spark, plan.transform(raw)))


@register("clean_table", _EVENTS_CLEAN_CTES + f"""
SELECT {_clip_expr('event_id', 0)} AS event_id, epoch_us(ts) AS ts_us, {_clip_expr('user_id', 1)} AS user_id,
       event_type, round({_clip_expr('value', 2)}, 6) AS value, props
FROM imp, q_imp""")
def q_clean_table(spark, sf):
    raw = dirty_events(spark, sf)
    plan = CleaningPlan.fit(raw, order_by=["event_id"])
    return _events_out(plan.transform(raw))


_COERCE_SQL = ("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a' "
               "ELSE CAST(user_id AS STRING) || '.5' END AS raw_amount FROM events")


@register("coerce_numeric", f"""
SELECT event_id, try_cast(raw_amount AS DOUBLE) AS amount FROM ({_COERCE_SQL})
WHERE try_cast(raw_amount AS DOUBLE) IS NOT NULL""")
def q_coerce_numeric(spark, sf):
    df = sql(spark, sf, _COERCE_SQL, ("events",))
    return coerce_numeric(df, "raw_amount", alias="amount").select("event_id", "amount")


_WORDS = ", ".join("(" + ", ".join("'" + v + "'" for v in (d, *w.values())) + ")" for d, w in V.VOCAB.items())


def _sentence(text: str) -> str:
    """A sentence format as SQL text."""
    return "concat(" + ", ".join(p if i % 2 else "'" + p + "'" for i, p in enumerate(re.split(r"[{}]", text)) if p) + ")"


@register("cleaning_sentences", _EVENTS_CLEAN_CTES + f""",
{_clip_ctes('src', EV_NUM)},
w(domain, {', '.join(V.VOCAB['general'])}) AS (VALUES {_WORDS}),
f AS (SELECT (SELECT count(*) FROM src) AS n_rows, 6 AS n_cols, (SELECT count(*) FROM src) - (SELECT count(*) FROM d) AS n_duplicates,
  (SELECT 6 * count(*) - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props) FROM src) AS total_missing,
  (SELECT CAST(n_0 + n_1 + n_2 AS BIGINT) FROM c_src) AS total_outliers, (SELECT count(*) FROM d) AS n_rows_after, 6 AS n_cols_after, 2 AS n_imputed,
  (SELECT CAST(n_0 > 0 AS INT) + CAST(n_1 > 0 AS INT) + CAST(n_2 > 0 AS INT) FROM c_imp) AS n_clipped, 'True' AS none_missing)
SELECT domain, {_sentence(X.CLEAN_BEFORE)} AS before, {_sentence(X.CLEAN_AFTER)} AS after FROM w, f""")
def q_cleaning_sentences(spark, sf):
    raw = dirty_events(spark, sf)
    plan = CleaningPlan.fit(raw, order_by=["event_id"])
    before, after = P.overview(raw), P.overview(plan.transform(raw))
    outliers = P.iqr_outliers(raw, EV_NUM).agg(F.sum("n_outliers").alias("total_outliers"))
    facts = before.crossJoin(outliers).crossJoin(after.select(  # three rows of one table each
        F.col("n_rows").alias("n_rows_after"), F.col("n_cols").alias("n_cols_after"), F.col("total_missing").alias("total_missing_after"))).withColumns(
        {"n_imputed": F.lit(len(plan.impute)), "n_clipped": F.lit(len(plan.clip))})
    requests = spark.createDataFrame([(d,) for d in V.VOCAB], "domain string")
    return cleaning_sentences(facts, TG.vocab_for(requests, V.vocab_frame(spark)).drop("eff_domain"))
