"""Column-level helpers shared by every operator (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> str:
    """Back-quote a column name for use inside SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_numeric(dt: T.DataType) -> bool:
    # Booleans are not numeric here (they get their own kind).
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def schema_kind(dt: T.DataType) -> str:
    """Kind implied by the Spark type alone (strings are refined by content)."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_datetime(dt):
        return "datetime"
    if is_numeric(dt):
        return "numeric"
    return "string"


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN in float/double columns becomes null, so null is the only 'missing'.

    A narrow projection; keeps column order and names.
    """
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)



def adjusted_skew(c: Column) -> Column:
    """Sample-adjusted skewness G1 = g1 * sqrt(n(n-1)) / (n-2); 0 when n <= 2.

    Spark's ``skewness`` is the population g1. A constant column gives 0.
    """
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    g = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.coalesce(F.nanvl(g, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (used for cross-engine result checks)."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            out.append(F.round(c.cast("double"), digits).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def ntz_micros(name: str) -> Column:
    """A TIMESTAMP_NTZ column as microseconds since 1970-01-01 00:00 (wall clock,
    independent of the session time zone)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"CAST({q(name)} AS TIMESTAMP_NTZ))")


def fixed_text(c: Column, decimals: int) -> Column:
    """A double with a fixed number of decimals, rounded as its exact binary value says
    (exact halves to the even digit), as C and Python print it. For values below 1e12.

    Whether x lies above or below the midpoint (2 f + 1) / (2 unit) is decided without
    error: x is split into two halves of few bits, whose products with 2 unit are exact."""
    x = F.abs(c.cast("double"))
    if decimals == 0:
        return F.format_string("%.0f", F.rint(c.cast("double")))
    unit = 10 ** decimals
    f = F.floor(x * unit).cast("double")
    wide = x * 134217729.0
    high = wide - (wide - x)
    side = (high * (2.0 * unit) - (2 * f + 1)) + (x - high) * (2.0 * unit)
    steps = (f + F.when((side > 0) | ((side == 0) & (f % 2 == 1)), 1.0).otherwise(0.0)).cast("long")
    text = F.concat(F.floor(steps / unit).cast("string"), F.lit("."), F.lpad((steps % unit).cast("string"), decimals, "0"))
    return F.when(x < 1e12, F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), text)).otherwise(
        F.format_string(f"%.{decimals}f", c.cast("double")))
