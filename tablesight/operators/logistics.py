"""Logistics tables (M1-M12): route coordinates, arcs, points, reorder points, samples.

The coordinate map is the user's (location -> lat/lon) table: its size is what
the user typed, so it is broadcast. Everything else is a grouped aggregate or
a range-bucketed ordered operation (``functions.ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.ordered import global_row_number
from ..functions.quantiles import group_quantiles, quantile_map

REORDER_PCT = 20.0
EVEN_SAMPLE = 120
DISTINCT_LOCATIONS = 12
COLOR_DELAYED, COLOR_ON_TIME = "retrasado", "a_tiempo"


def clean_coordinates(coords: DataFrame) -> DataFrame:
    """M8: drop placeholder coordinates (0, 0) and incomplete entries."""
    return coords.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()
                         & ~((F.col("lat") == 0) & (F.col("lon") == 0)))


def route_coordinates(df: DataFrame, location: str, coords: DataFrame, keep: Sequence[str] = (),
                      max_routes: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """M1/M2: rows with a non-null location mapped to the user's coordinates (inner
    equi-join on the location as string); unmapped rows are dropped. ``max_routes`` is
    the optional display cap of the reference (off by default)."""
    rows = df.filter(col(location).isNotNull())
    if max_routes is not None:
        rows = rows.orderBy(*[col(c) for c in order_by]).limit(max_routes)
    c = clean_coordinates(coords).select(F.col("location").cast("string").alias("__loc"), "lat", "lon")  # its size decides the join
    return rows.join(c, col(location).cast("string") == F.col("__loc")).select(
        *[col(k) for k in keep], col(location).cast("string").alias("destino"), "lat", "lon")


def unmapped_locations(df: DataFrame, location: str, coords: DataFrame) -> DataFrame:
    """M1: distinct non-null locations with no usable coordinates (anti join)."""
    c = clean_coordinates(coords).select(F.col("location").cast("string").alias("__loc"))
    locs = df.filter(col(location).isNotNull()).select(col(location).cast("string").alias("destino")).distinct()
    return locs.join(c, F.col("destino") == F.col("__loc"), "left_anti")


def route_centroid(routes: DataFrame) -> DataFrame:
    """M3: origin = mean of the mapped destinations."""
    return routes.agg(F.avg("lat").alias("origin_lat"), F.avg("lon").alias("origin_lon"),
                      F.count(F.lit(1)).cast("long").alias("n_routes"))


def delay_flag(c: Column) -> Column:
    """M4: numeric(delay) > 0; missing or non-numeric counts as not delayed."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0)) > 0


def route_arcs(routes: DataFrame, delayed: str = "delayed") -> DataFrame:
    """M5: one arc per destination from the centroid, with route counts and delay rate."""
    per = routes.groupBy("destino", "lat", "lon").agg(
        F.count(F.lit(1)).cast("long").alias("n_routes"),
        F.sum(F.col(delayed).cast("int")).cast("long").alias("n_delayed"))
    # the centroid from the places' counts: a row per place of the coordinate table
    every = Window.partitionBy()
    mean = {c: F.sum(F.col(c) * F.col("n_routes")).over(every) / F.sum("n_routes").over(every) for c in ("lat", "lon")}
    return per.select(
        mean["lat"].alias("from_lat"), mean["lon"].alias("from_lon"),
        F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), "destino", "n_routes", "n_delayed",
        (F.col("n_delayed") / F.col("n_routes")).alias("delay_rate"),
        F.when(F.col("n_delayed") > 0, F.lit(COLOR_DELAYED)).otherwise(F.lit(COLOR_ON_TIME)).alias("status"))


def route_arc_rows(routes: DataFrame, delayed: str = "delayed", keep: Sequence[str] = ()) -> DataFrame:
    """M5: one arc per route row, from the centroid to the row's place, with its own status."""
    o = route_centroid(routes).first()  # the origin is one point
    return routes.select(
        *[col(k) for k in keep], F.lit(o["origin_lat"]).cast("double").alias("from_lat"),
        F.lit(o["origin_lon"]).cast("double").alias("from_lon"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), "destino",
        F.when(F.col(delayed), F.lit(COLOR_DELAYED)).otherwise(F.lit(COLOR_ON_TIME)).alias("status"))


def point_layer(df: DataFrame, lat: str, lon: str, keep: Sequence[str] = ()) -> DataFrame:
    """M6: rows with both real coordinates, plus the mean centre on every row."""
    pts = df.filter(col(lat).isNotNull() & col(lon).isNotNull()).select(
        *[col(k) for k in keep], col(lat).cast("double").alias("lat"), col(lon).cast("double").alias("lon"))
    c = pts.agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon")).first()
    return pts.withColumn("center_lat", F.lit(c["center_lat"]).cast("double")) \
              .withColumn("center_lon", F.lit(c["center_lon"]).cast("double"))


def distinct_locations(df: DataFrame, location: str, k: int = DISTINCT_LOCATIONS) -> DataFrame:
    """M7 (a top-k list): the first ``k`` distinct locations sorted as strings."""
    return (df.filter(col(location).isNotNull()).select(col(location).cast("string").alias("location"))
            .distinct().orderBy("location").limit(k))


def reorder_point(df: DataFrame, stock: str, group_by: Sequence[str] = (), pct: float = REORDER_PCT,
                  accuracy: int | None = None) -> DataFrame:
    """M9: reorder point = P``pct`` of the stock (linear), with mean/min/max; 0s if empty."""
    x = F.expr(f"try_cast(`{stock}` AS DOUBLE)")
    g = list(group_by)
    rest = [F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.min(x), F.lit(0.0)).alias("min"),
            F.coalesce(F.max(x), F.lit(0.0)).alias("max")]
    if accuracy is None and g:
        found = group_quantiles(df.withColumn("__stock", x), ["__stock"], [pct / 100.0], g, rest)
        return found.select(*g, F.coalesce(F.col("__q0")[0], F.lit(0.0)).alias("rop"), F.lit(pct).alias("percentile"), "mean", "min", "max")
    if accuracy is None:
        found = quantile_map(df.select(x.alias("__stock")), ["__stock"], [pct / 100.0]).get("__stock", [0.0])
        return df.agg(*rest).select(F.lit(found[0]).alias("rop"), F.lit(pct).alias("percentile"), "mean", "min", "max")
    q = F.percentile_approx(x, pct / 100.0, accuracy)
    return df.groupBy(*[col(c) for c in g]).agg(
        F.coalesce(q, F.lit(0.0)).alias("rop"), F.lit(pct).alias("percentile"), *rest)


def below_reorder(df: DataFrame, stock: str, rop: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Flag each record whose stock is below its group's reorder point."""
    r = rop.select(*group_by, "rop")
    # One row per group: the number of groups grows with the data, so no broadcast
    # hint - AQE picks a broadcast at run time when the table turns out small.
    j = (df.join(r, list(group_by), "left") if group_by
         else df.withColumn("rop", F.lit(r.first()["rop"]).cast("double")))
    return j.withColumn("below_rop", col(stock).cast("double") < F.col("rop"))


def even_sample(df: DataFrame, order_by: Sequence[str], m: int = EVEN_SAMPLE,
                group_by: Sequence[str] = ()) -> DataFrame:
    """Sequence index 0..n-1 in ``order_by`` order (per group) and at most ``m``
    evenly spaced records, indices floor(linspace(0, n-1, m)); the chosen indices are a
    generated table joined back (semi join)."""
    seq = global_row_number(df, order_by, name="seq_idx", partition_by=group_by)
    sizes = seq.groupBy(*[col(g) for g in group_by]).agg(F.count(F.lit(1)).alias("__n"))
    j = F.explode(F.sequence(F.lit(0), F.least(F.col("__n"), F.lit(m)) - 1))
    idx = sizes.select(*group_by, "__n", j.alias("__j")).select(
        *group_by,
        F.when(F.col("__n") <= m, F.col("__j"))
        .otherwise(F.floor(F.col("__j") * (F.col("__n") - 1) / F.lit(m - 1))).cast("long").alias("seq_idx"))
    return seq.join(idx.distinct(), [*group_by, "seq_idx"], "left_semi")
