"""Order-dependent operations without a partition key, done at scale.

A window with ``orderBy`` but no ``partitionBy`` runs in one task. Here the
ordering key is cut into ranges at approximate quantiles (one aggregate pass),
each range is processed by its own window partition, and what crosses a range
border (a count, a running sum, the last non-null value) is carried over
through a per-range summary table whose size is the number of ranges - a
parameter, not a function of the data. That summary is the only thing joined
back, with a broadcast hint.

Ties in the first ordering column stay in one range, so give a unique ordering
(e.g. ``[ts, id]``); ranges are balanced when the first column is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, is_datetime, is_numeric, ntz_micros

BUCKET = "__range_bucket"


#: Rows of the sample that borders between string keys come from, per range.
SAMPLED = 64


def _sort_key(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if is_numeric(dt):
        return col(name).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        return ntz_micros(name).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(col(name)).cast("double")
    if is_datetime(dt):
        return F.unix_micros(col(name)).cast("double")
    if isinstance(dt, T.BooleanType):
        return col(name).cast("double")
    if isinstance(dt, T.StringType):
        return col(name)
    raise TypeError(f"range bucketing needs a numeric, datetime or string first key, got {dt}")


def _borders(df: DataFrame, key: Column, order_by: Sequence[str], n_buckets: int) -> list:
    """At most ``n_buckets`` - 1 ascending values that cut the rows into ranges of similar size.

    Strings are cut at whole values of a sample of about ``SAMPLED`` distinct orderings per
    range (those whose hash is small enough; the bound does not grow with the table)."""
    if not isinstance(df.schema[order_by[0]].dataType, T.StringType):
        probs = [i / n_buckets for i in range(1, n_buckets)]
        return df.select(F.percentile_approx(key, probs, 10000).alias("b")).first()["b"] or []
    n = df.filter(key.isNotNull()).count()
    share = min(1.0, SAMPLED * n_buckets / max(1, n))
    spread = F.xxhash64(*[col(c) for c in order_by]).bitwiseAND((1 << 40) - 1)
    sample = df.filter(key.isNotNull() & (spread < int(share * (1 << 40)) + 1)).select(*[col(c) for c in order_by]).distinct()
    values = sorted((r["k"] for r in sample.select(key.alias("k")).collect()), key=lambda v: v.encode("utf-8"))  # in Spark's order
    return [values[len(values) * i // n_buckets] for i in range(1, n_buckets)] if values else []


def _place(key: Column, borders: list, first: int = 0) -> Column:
    """How many borders are smaller than the key: a balanced tree of comparisons."""
    if not borders:
        return F.lit(first)
    m = len(borders) // 2
    return F.when(key <= F.lit(borders[m]), _place(key, borders[:m], first)).otherwise(_place(key, borders[m + 1:], first + m + 1))


def default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def with_range_bucket(df: DataFrame, order_by: Sequence[str],
                      n_buckets: int | None = None) -> DataFrame:
    """Add ``__range_bucket``: rows with a smaller first key never get a larger bucket."""
    n_buckets = n_buckets or default_buckets(df)
    key = _sort_key(df, order_by[0])
    if n_buckets <= 1:
        return df.withColumn(BUCKET, F.lit(0))
    # n_buckets - 1 values come to the driver: bounded by the parameter
    borders = list(dict.fromkeys(x for x in _borders(df, key, order_by, n_buckets) if x is not None))
    if not isinstance(df.schema[order_by[0]].dataType, T.StringType):
        borders = sorted(float(b) for b in borders)
    return df.withColumn(BUCKET, F.when(key.isNull(), F.lit(0)).otherwise(_place(key, borders)))


def _order_cols(order_by: Sequence[str]) -> list[Column]:
    return [col(c).asc_nulls_first() for c in order_by]


def _reverse_cols(order_by: Sequence[str]) -> list[Column]:
    # The exact reverse of ``_order_cols``: "first non-null at or after the row" is
    # "last non-null at or before it" in this order - a growing frame, linear time
    # (a frame ending at UNBOUNDED FOLLOWING is re-evaluated per row).
    return [col(c).desc_nulls_last() for c in order_by]


def _join_back(b: DataFrame, small: DataFrame, parts: Sequence[str]) -> DataFrame:
    """``b`` with the columns of ``small``, which has a row per (group, range). A null group is
    a group. Without groups there is one row per range, so it is broadcast."""
    keys = [*parts, BUCKET]
    named = small.select(*[col(c).alias(f"__key_{i}") for i, c in enumerate(keys)], *[col(c) for c in small.columns if c not in keys])
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & col(c).eqNullSafe(F.col(f"__key_{i}"))
    return b.join(named if parts else F.broadcast(named), on, "left").drop(*[f"__key_{i}" for i in range(len(keys))])


def _carry(b: DataFrame, parts: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (group, range) totals turned into exclusive prefix sums over the ranges of
    each group. One row per (group, range)."""
    g = [col(c) for c in parts]
    tot = b.groupBy(*g, BUCKET).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    prev = Window.partitionBy(*g).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return tot.select(*g, BUCKET, *[F.coalesce(F.sum(n).over(prev), F.lit(0)).alias(n + "_off") for n in sums])


def global_row_number(df: DataFrame, order_by: Sequence[str], name: str = "row_idx",
                      partition_by: Sequence[str] = (), n_buckets: int | None = None,
                      start: int = 0) -> DataFrame:
    """0-based (or ``start``-based) row number over ``order_by`` (within ``partition_by``).

    Windows run per (group, key range); the counts of the earlier ranges of the
    group are added back, so no single task holds a whole group."""
    parts = [col(c) for c in partition_by]
    pnames = list(partition_by)
    b = with_range_bucket(df, order_by, n_buckets)
    w = Window.partitionBy(*parts, F.col(BUCKET)).orderBy(*_order_cols(order_by))
    local = b.withColumn("__local_rn", F.row_number().over(w))
    off = _carry(b, pnames, {"__n": F.lit(1)})
    out = _join_back(local, off, pnames)
    return out.withColumn(name, (F.col("__n_off") + F.col("__local_rn") - 1 + start).cast("long")) \
              .drop("__n_off", "__local_rn", BUCKET)


def running_sums(df: DataFrame, order_by: Sequence[str], sums: dict[str, Column],
                 partition_by: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Inclusive running sums ``{out_name: expr}`` in ``order_by`` order (within groups)."""
    parts = [col(c) for c in partition_by]
    pnames = list(partition_by)
    b = with_range_bucket(df, order_by, n_buckets)
    tmp = {name: f"__t_{i}" for i, name in enumerate(sums)}
    for name, e in sums.items():
        b = b.withColumn(tmp[name], e)
    off = _carry(b, pnames, {tmp[n]: F.col(tmp[n]) for n in sums})
    b = _join_back(b, off, pnames)
    w = (Window.partitionBy(*parts, F.col(BUCKET)).orderBy(*_order_cols(order_by))
         .rowsBetween(Window.unboundedPreceding, 0))
    for name in sums:
        b = b.withColumn(name, F.sum(tmp[name]).over(w) + F.col(tmp[name] + "_off"))
    drop = [BUCKET] + list(tmp.values()) + [t + "_off" for t in tmp.values()]
    return b.drop(*drop)


def fill_forward_backward(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                          partition_by: Sequence[str] = (),
                          n_buckets: int | None = None) -> DataFrame:
    """Forward fill then backward fill ``cols`` in ``order_by`` order (within groups).

    Forward fill takes the last non-null value at or before the row; rows before
    the first non-null get the first non-null value (the backward fill).
    """
    cols = list(cols)
    if not cols:
        return df
    order, names = _order_cols(order_by), list(partition_by)
    parts = [col(c) for c in names]
    b = with_range_bucket(df, order_by, n_buckets)
    okey = F.struct(*[col(c) for c in order_by])
    # Per (group, range) the last and first non-null value; what a range takes over from
    # those before and after it is found among the ranges of its group.
    summ = b.groupBy(*parts, BUCKET).agg(
        *[F.max_by(col(c), F.when(col(c).isNotNull(), okey)).alias(f"__last_{i}") for i, c in enumerate(cols)],
        *[F.min_by(col(c), F.when(col(c).isNotNull(), okey)).alias(f"__first_{i}") for i, c in enumerate(cols)],
    )
    prev = Window.partitionBy(*parts).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    nxt = Window.partitionBy(*parts).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)
    carry = summ.select(
        *parts, BUCKET,
        *[F.last(f"__last_{i}", True).over(prev).alias(f"__cf_{i}") for i in range(len(cols))],
        *[F.first(f"__first_{i}", True).over(nxt).alias(f"__cb_{i}") for i in range(len(cols))],
    )
    b = _join_back(b, carry, names)
    wf = Window.partitionBy(*parts, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(*parts, BUCKET).orderBy(*_reverse_cols(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    for i, c in enumerate(cols):
        # Both windows share the partitioning, so Spark sorts once per direction.
        b = b.withColumn(f"__ff_{i}", F.last(col(c), True).over(wf))
    for i, c in enumerate(cols):
        b = b.withColumn(f"__bf_{i}", F.last(col(c), True).over(wb))
    for i, c in enumerate(cols):
        b = b.withColumn(c, F.coalesce(F.col(f"__ff_{i}"), F.col(f"__cf_{i}"), F.col(f"__bf_{i}"),
                                       F.col(f"__cb_{i}")))
    b = b.drop(*[f"__ff_{i}" for i in range(len(cols))], *[f"__bf_{i}" for i in range(len(cols))])
    return b.drop(BUCKET, *[f"__cf_{i}" for i in range(len(cols))],
                  *[f"__cb_{i}" for i in range(len(cols))])
