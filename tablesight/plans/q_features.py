"""Checked queries for feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators.features import (FeatureEncoder, encode_target, fit_target, quantile_bins,
                                  standardize)
from .registry import register
from .tables import DIRTY_EVENTS_SQL, GAPPY_EVENTS_SQL, dirty_events, gappy_events, load, sql


def _long(df, key: str, prefix: str = ""):
    cols = [c for c in df.columns if c != key and c.startswith(prefix)]
    return df.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(f"`{c}`").alias("value")) for c in cols])))


@register("features_numeric", f"""
WITH src AS ({DIRTY_EVENTS_SQL})
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM src)), 6) AS value FROM src""")
def q_features_numeric(spark, sf):
    df = dirty_events(spark, sf).select("event_id", "value")
    enc = FeatureEncoder.fit(df, exclude=["event_id"])
    return round_doubles(enc.transform(df, keep=["event_id"]))


_BOOL_SQL = "SELECT event_id, value > 100 AS high_value FROM events"


@register("features_bool", f"SELECT event_id, CAST(high_value AS INT)::DOUBLE AS high_value FROM ({_BOOL_SQL})")
def q_features_bool(spark, sf):
    df = sql(spark, sf, _BOOL_SQL, ("events",))
    return FeatureEncoder.fit(df, exclude=["event_id"]).transform(df, keep=["event_id"])


@register("features_date_parts", f"""
SELECT event_id, CAST(coalesce(year(ts), 0) AS DOUBLE) AS ts_anio, CAST(coalesce(month(ts), 0) AS DOUBLE) AS ts_mes,
       CAST(coalesce(day(ts), 0) AS DOUBLE) AS ts_dia FROM ({GAPPY_EVENTS_SQL})""")
def q_features_date_parts(spark, sf):
    df = gappy_events(spark, sf).select("event_id", "ts")
    return FeatureEncoder.fit(df, exclude=["event_id"]).transform(df, keep=["event_id"])


@register("one_hot", f"""
WITH src AS ({DIRTY_EVENTS_SQL}), cats AS (SELECT DISTINCT coalesce(event_type, 'nan') AS v FROM src)
SELECT event_id, 'event_type_' || v AS feature_name,
       CASE WHEN coalesce(event_type, 'nan') = v THEN 1.0 ELSE 0.0 END::DOUBLE AS value
FROM src CROSS JOIN cats""")
def q_one_hot(spark, sf):
    df = dirty_events(spark, sf).select("event_id", "event_type")
    enc = FeatureEncoder.fit(df, exclude=["event_id"])
    return _long(enc.transform(df, keep=["event_id"]), "event_id", "event_type_")


_BAD_SQL = ("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) "
            "WHEN event_id % 7 = 1 THEN CAST('Infinity' AS DOUBLE) "
            "WHEN event_id % 7 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS x FROM events")


@register("sanitize_features", f"""
WITH src AS ({_BAD_SQL}),
m AS (SELECT avg(x) FILTER (WHERE NOT isnan(x)) AS mean FROM src),
f AS (SELECT event_id, CASE WHEN isnan(x) THEN (SELECT mean FROM m) ELSE x END AS x FROM src)
SELECT event_id, round(CASE WHEN isnan(x) OR isinf(x) THEN 0.0 ELSE x END, 6) AS x FROM f""")
def q_sanitize_features(spark, sf):
    df = sql(spark, sf, _BAD_SQL, ("events",))
    return round_doubles(FeatureEncoder.fit(df, exclude=["event_id"]).transform(df, keep=["event_id"]))


@register("encode_target_continuous", f"""
WITH src AS ({DIRTY_EVENTS_SQL})
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM src)), 6) AS label FROM src""")
def q_encode_target_continuous(spark, sf):
    df = dirty_events(spark, sf).select("event_id", "value")
    enc = fit_target(df, "value")
    return round_doubles(encode_target(df, "value", enc).select("event_id", "label"))


@register("encode_target_codes", f"""
WITH src AS ({DIRTY_EVENTS_SQL}),
labs AS (SELECT event_type AS lab, CAST(row_number() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code,
                n FROM (SELECT event_type, count(*) AS n FROM src WHERE event_type IS NOT NULL GROUP BY event_type)),
maj AS (SELECT code FROM labs ORDER BY n DESC, code LIMIT 1)
SELECT event_id, coalesce(labs.code, (SELECT code FROM maj)) AS label
FROM src LEFT JOIN labs ON src.event_type = labs.lab""")
def q_encode_target_codes(spark, sf):
    df = dirty_events(spark, sf).select("event_id", "event_type")
    enc = fit_target(df, "event_type")
    return encode_target(df, "event_type", enc).select("event_id", "label")


@register("quantile_bins", """
WITH e AS (SELECT quantile_cont(l_extendedprice, 0.3333333333333333) AS e1,
                  quantile_cont(l_extendedprice, 0.6666666666666666) AS e2 FROM lineitem)
SELECT l_orderkey, l_linenumber,
       (CASE WHEN l_extendedprice >= e1 THEN 1 ELSE 0 END) + (CASE WHEN l_extendedprice >= e2 THEN 1 ELSE 0 END) AS bin,
       CASE WHEN l_extendedprice >= e2 THEN 'alto' WHEN l_extendedprice >= e1 THEN 'medio' ELSE 'bajo' END AS bin_label
FROM lineitem, e""")
def q_quantile_bins(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return quantile_bins(li, "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "bin", F.col("bin_label"))


_STD_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("standardize", "WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _STD_COLS)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _STD_COLS) + " FROM lineitem, s")
def q_standardize(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_STD_COLS)
    out, _ = standardize(li, _STD_COLS)
    return round_doubles(out)


@register("align_features", """
WITH cats AS (SELECT DISTINCT c_mktsegment AS v FROM customer)
SELECT c_custkey, 'c_nationkey' AS feature_name, 0.0::DOUBLE AS value FROM customer
UNION ALL SELECT c_custkey, 'c_acctbal', round(c_acctbal, 6) FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment_' || v, CASE WHEN c_mktsegment = v THEN 1.0 ELSE 0.0 END::DOUBLE
FROM customer CROSS JOIN cats""")
def q_align_features(spark, sf):
    cust = load(spark, sf, "customer")
    enc = FeatureEncoder.fit(cust.select("c_nationkey", "c_acctbal", "c_mktsegment"))
    # Scenario rows carry only some of the training columns plus an unknown one.
    scen = cust.select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_name").alias("unknown_col"))
    return round_doubles(_long(enc.transform(scen, keep=["c_custkey"]), "c_custkey"))
