"""Checked queries for the logistics tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import logistics as L
from .registry import register
from .tables import derived, derived_duck, sql

# The user's coordinate map (what the reference asks the user to type in): one
# placeholder (0, 0) entry, which is dropped, and one location absent from the data.
COORDS = [("africa", 0.0, 20.0), ("america", 15.0, -90.0), ("asia", 35.0, 100.0),
          ("europe", 50.0, 10.0), ("middle east", 0.0, 0.0), ("oceania", -25.0, 135.0)]
_COORDS_SQL = "coords(location, lat, lon) AS (VALUES " + ", ".join(
    f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for n, a, b in COORDS) + ")"
_LG = f"lg AS ({derived_duck('logistica')})"
_CLEAN = "cc AS (SELECT * FROM coords WHERE NOT (lat = 0 AND lon = 0))"


def _coords(spark):
    return spark.createDataFrame(COORDS, "location string, lat double, lon double")


def _routes(spark, sf):
    lg = derived(spark, sf, "logistica").withColumn("delayed", L.delay_flag(F.col("retraso_entrega")))
    return L.route_coordinates(lg, "ruta", _coords(spark), keep=["pedido_id", "linea", "delayed"])


_ROUTES_SQL = f"""WITH {_LG}, {_COORDS_SQL}, {_CLEAN},
r AS (SELECT pedido_id, linea, coalesce(try_cast(CAST(retraso_entrega AS VARCHAR) AS DOUBLE), 0) > 0 AS delayed,
             CAST(ruta AS VARCHAR) AS destino, cc.lat, cc.lon
      FROM lg JOIN cc ON CAST(lg.ruta AS VARCHAR) = cc.location WHERE ruta IS NOT NULL)"""


@register("route_coordinates", _ROUTES_SQL + " SELECT pedido_id, linea, destino, lat, lon FROM r")
def q_route_coordinates(spark, sf):
    return _routes(spark, sf).select("pedido_id", "linea", "destino", "lat", "lon")


@register("unmapped_locations", f"""WITH {_LG}, {_COORDS_SQL}, {_CLEAN}
SELECT DISTINCT CAST(ruta AS VARCHAR) AS destino FROM lg WHERE ruta IS NOT NULL
  AND CAST(ruta AS VARCHAR) NOT IN (SELECT location FROM cc)""")
def q_unmapped_locations(spark, sf):
    return L.unmapped_locations(derived(spark, sf, "logistica"), "ruta", _coords(spark))


@register("route_centroid", _ROUTES_SQL + """
SELECT round(avg(lat), 6) AS origin_lat, round(avg(lon), 6) AS origin_lon, CAST(count(*) AS BIGINT) AS n_routes FROM r""")
def q_route_centroid(spark, sf):
    return round_doubles(L.route_centroid(_routes(spark, sf)))


_DELAY_SQL = ("SELECT pedido_id, linea, CASE WHEN linea = 1 THEN 'n/a' "
              "ELSE CAST(lead_time_dias AS STRING) END AS retraso_txt FROM lg")


@register("delay_flag", f"""WITH {_LG}, d AS ({_DELAY_SQL})
SELECT pedido_id, linea, coalesce(try_cast(retraso_txt AS DOUBLE), 0) > 0 AS delayed FROM d""")
def q_delay_flag(spark, sf):
    derived(spark, sf, "logistica").createOrReplaceTempView("lg")
    d = spark.sql(_DELAY_SQL)
    return d.select("pedido_id", "linea", L.delay_flag(F.col("retraso_txt")).alias("delayed"))


@register("route_arcs", _ROUTES_SQL + """,
o AS (SELECT avg(lat) AS origin_lat, avg(lon) AS origin_lon FROM r),
per AS (SELECT destino, lat, lon, count(*) AS n_routes, sum(CAST(delayed AS INT)) AS n_delayed FROM r
        GROUP BY destino, lat, lon)
SELECT round(origin_lat, 6) AS from_lat, round(origin_lon, 6) AS from_lon, lat AS to_lat, lon AS to_lon, destino,
       CAST(n_routes AS BIGINT) AS n_routes, CAST(n_delayed AS BIGINT) AS n_delayed,
       round(n_delayed / n_routes, 6) AS delay_rate,
       CASE WHEN n_delayed > 0 THEN 'retrasado' ELSE 'a_tiempo' END AS status FROM per, o""")
def q_route_arcs(spark, sf):
    return round_doubles(L.route_arcs(_routes(spark, sf)))


@register("route_arc_rows", _ROUTES_SQL + """,
o AS (SELECT avg(lat) AS origin_lat, avg(lon) AS origin_lon FROM r)
SELECT round(origin_lat, 6) AS from_lat, round(origin_lon, 6) AS from_lon, round(lat, 6) AS to_lat, round(lon, 6) AS to_lon, destino,
       CASE WHEN delayed THEN 'retrasado' ELSE 'a_tiempo' END AS status FROM r, o""")
def q_route_arc_rows(spark, sf):
    return round_doubles(L.route_arc_rows(_routes(spark, sf)))


_POINTS_SQL = ("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL "
               "ELSE c_nationkey * 3.0 - 40 + (c_custkey % 10) * 0.1 END AS latitud, "
               "c_nationkey * 7.0 - 90 AS longitud FROM customer")


@register("point_layer", f"""WITH p AS ({_POINTS_SQL}),
pts AS (SELECT c_custkey, CAST(latitud AS DOUBLE) AS lat, CAST(longitud AS DOUBLE) AS lon FROM p
        WHERE latitud IS NOT NULL AND longitud IS NOT NULL)
SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon, round((SELECT avg(lat) FROM pts), 6) AS center_lat,
       round((SELECT avg(lon) FROM pts), 6) AS center_lon FROM pts""")
def q_point_layer(spark, sf):
    p = sql(spark, sf, _POINTS_SQL, ("customer",))
    return round_doubles(L.point_layer(p, "latitud", "longitud", keep=["c_custkey"]))


@register("distinct_locations", f"""WITH {_LG}
SELECT DISTINCT CAST(ruta AS VARCHAR) AS location FROM lg WHERE ruta IS NOT NULL ORDER BY location LIMIT 12""")
def q_distinct_locations(spark, sf):
    return L.distinct_locations(derived(spark, sf, "logistica"), "ruta")


_ROP_SQL = f"""WITH {_LG},
rop AS (SELECT ruta, coalesce(quantile_cont(stock_disponible, 0.2), 0) AS rop, 20.0::DOUBLE AS percentile,
               coalesce(avg(stock_disponible), 0) AS mean, coalesce(min(stock_disponible), 0) AS min,
               coalesce(max(stock_disponible), 0) AS max FROM lg GROUP BY ruta)"""


@register("reorder_point", _ROP_SQL + """
SELECT ruta, round(rop, 6) AS rop, percentile, round(mean, 6) AS mean, min, max FROM rop""")
def q_reorder_point(spark, sf):
    return round_doubles(L.reorder_point(derived(spark, sf, "logistica"), "stock_disponible", ["ruta"]))


@register("below_reorder", _ROP_SQL + """
SELECT lg.pedido_id, lg.linea, lg.ruta, lg.stock_disponible < rop.rop AS below_rop
FROM lg JOIN rop ON lg.ruta = rop.ruta""")
def q_below_reorder(spark, sf):
    lg = derived(spark, sf, "logistica")
    rop = L.reorder_point(lg, "stock_disponible", ["ruta"])
    return L.below_reorder(lg, "stock_disponible", rop, ["ruta"]).select("pedido_id", "linea", "ruta", "below_rop")


@register("even_sample", f"""WITH {_LG},
s AS (SELECT ruta, pedido_id, linea, row_number() OVER (PARTITION BY ruta ORDER BY pedido_id, linea) - 1 AS seq_idx,
             count(*) OVER (PARTITION BY ruta) AS n FROM lg),
g AS (SELECT DISTINCT ruta, n FROM s),
idx AS (SELECT DISTINCT ruta, CAST(CASE WHEN n <= 120 THEN j ELSE floor(j * (n - 1) / 119) END AS BIGINT) AS seq_idx
        FROM g, range(0, 120) t(j) WHERE j < least(n, 120))
SELECT s.ruta, pedido_id, linea, s.seq_idx FROM s JOIN idx ON s.ruta = idx.ruta AND s.seq_idx = idx.seq_idx""")
def q_even_sample(spark, sf):
    lg = derived(spark, sf, "logistica").select("ruta", "pedido_id", "linea")
    return L.even_sample(lg, ["pedido_id", "linea"], group_by=["ruta"]).select("ruta", "pedido_id", "linea",
                                                                                  "seq_idx")
