"""Profiling and data-quality operators (overview, column profile, kinds, IQR).

Missing counts come from one narrow ``agg``. The exact column profile comes from one
"long" pass: every cell becomes a short row of its column and value, which is reduced to
distinct ``(column, value) -> count`` rows with map-side partial aggregation (a hot value
costs one row per map task, not one row per cell). Null counts, distinct counts, average
length and date-parse share all come from that reduced table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FLOAT_TYPES, col, is_numeric, normalize_missing, schema_kind
from ..functions.quantiles import quantile_map
from ..functions.repeats import duplicates

# Fixed values of the reference's kind rules.
TEXT_MIN_UNIQUE = 50          # more distinct values than this ...
TEXT_MIN_UNIQUE_SHARE = 0.5   # ... and more than half of the values distinct ...
TEXT_MIN_AVG_LEN = 20         # ... and longer than this on average => free text
DATE_SHARE = 0.8              # share of values that parse as a date => datetime
SAMPLE_SIZE = 5               # sample values per column
HASH_FROM = 48                # longer values are told apart by their SHA-256
NO_MISSING_LABEL = "(sin nulos)"


def overview(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols, n_duplicates, total_missing (NaN counts as missing)."""
    df = normalize_missing(df)
    cols = df.columns
    null_sum = None
    for c in cols:
        term = F.sum(F.when(col(c).isNull(), 1).otherwise(0))
        null_sum = term if null_sum is None else null_sum + term
    base = df.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        (null_sum if null_sum is not None else F.lit(0)).cast("long").alias("total_missing"),
    )
    dups = duplicate_count(df)
    return base.crossJoin(dups).select(
        "n_rows", F.lit(len(cols)).cast("long").alias("n_cols"), "n_duplicates", "total_missing")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Exact duplicate rows beyond the first (nulls compare equal); whole rows meet only
    where their hash repeats."""
    return duplicates(df)


def _sort_number(dt: T.DataType, c: str) -> Column:
    return col(c).cast("double") if is_numeric(dt) or isinstance(dt, T.BooleanType) else F.lit(None).cast("double")


def sample_values(df: DataFrame, k: int = SAMPLE_SIZE, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, sample_values): the ``k`` smallest distinct non-null values per column.

    Values are made distinct first (partly in the map tasks), so neither a column of few
    values nor a frequent one fills a task; of the distinct values ``row_number() <= k``
    keeps k per column and task before they meet."""
    df = normalize_missing(df)
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema}
    cells = df.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), _sort_number(types[c], c).alias("num"), col(c).cast("string").alias("value")) for c in columns])))
    distinct = cells.filter(F.col("value").isNotNull()).groupBy("column_name", "num", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.col("num").asc_nulls_last(), F.col("value"))
    top = distinct.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return top.groupBy("column_name").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]).alias("sample_values"))


def _cell(ordinal: int, c: str, dt: T.DataType) -> Column:
    """(ordinal, whole, real, text) of a cell: equal where the cells of the column are equal,
    all but ``ordinal`` null where the cell is missing. Integers and dates go as ``whole``,
    floats as ``real`` (with a zero's sign as ``text``), all others as ``text``, with their
    length as ``whole``. Long texts go as their SHA-256, so ``real`` tells whether they parse
    as a date."""
    x, whole, real, text = col(c), F.lit(None), F.lit(None), F.lit(None)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        whole = x
    elif isinstance(dt, T.DateType):
        whole = F.unix_date(x)
    elif isinstance(dt, T.TimestampType):
        whole = F.unix_micros(x)
    elif isinstance(dt, FLOAT_TYPES):
        real, text = x, F.when(x == 0, x.cast("string"))
    elif schema_kind(dt) == "string":
        whole, long_ = F.length(x), F.length(x) > HASH_FROM
        real = F.when(long_, F.try_to_timestamp(x).isNotNull().cast("double"))
        text = F.when(long_, F.sha2(x, 256)).otherwise(x)
    else:
        text = x.cast("string")
    return F.struct(F.lit(ordinal).alias("ordinal"), whole.cast("long").alias("whole"),
                    real.cast("double").alias("real"), text.cast("string").alias("text"))


def _value_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``_narrow_stats`` with exact distinct counts, by one scan: all cells
    are counted by column and value, and length and date-parse share are taken from the
    distinct values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    strings = [i for i, c in enumerate(columns) if schema_kind(types[c]) == "string"]
    # strings (arrays too) are made once, before several parts of a cell use them
    texts = df.select(*[(col(c).cast("string") if i in strings else col(c)).alias(c) for i, c in enumerate(columns)])
    cells = texts.select(F.inline(F.array(*[_cell(i, c, types[c]) for i, c in enumerate(columns)])))
    counts = cells.groupBy("ordinal", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))
    # a row without copies for each column, so that an empty table has its columns
    none = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("ordinal"), F.lit(None).cast("long").alias("whole"), F.lit(None).cast("double").alias("real"),
        F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n")) for i in range(len(columns))])))
    there = F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))
    string = F.col("ordinal").isin(strings) & there
    dated = F.coalesce("real", F.try_to_timestamp(F.col("text")).isNotNull().cast("double"))
    n_strings = F.sum(F.when(string, F.col("n")))
    return counts.unionByName(none).groupBy("ordinal").agg(
        F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("n_missing"),
        F.count(F.when(there, 1)).alias("n_unique"),
        F.sum(F.when(there, F.col("n")).otherwise(0)).alias("n_non_null"),
        (F.sum(F.when(string, F.col("whole") * F.col("n"))) / n_strings).alias("avg_len"),
        (F.sum(F.when(string, dated * F.col("n"))) / n_strings).alias("date_share"),
    ).withColumn("column_name", F.get(F.array(*[F.lit(c) for c in columns]), F.col("ordinal")))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(ordinal, column_name, n_missing, n_non_null, pct_missing) by one narrow aggregate."""
    df = normalize_missing(df)
    return _narrow_stats(df, list(columns or df.columns), None).select(
        "ordinal", "column_name", "n_missing", "n_non_null", _pct_missing().alias("pct_missing"))


def _pct_missing() -> Column:
    n_rows = F.col("n_missing") + F.col("n_non_null")
    return F.when(n_rows > 0, F.round(F.col("n_missing") * 100.0 / n_rows, 2)).otherwise(F.lit(0.0))


def _narrow_stats(df: DataFrame, columns: list[str], rsd: float | None) -> DataFrame:
    """Per-column statistics from one narrow aggregate (no explode, no shuffle of cells).
    Length and date-parse share feed only the string-kind rules, so only string columns
    pay for them. With ``rsd`` the distinct counts are HyperLogLog estimates."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in columns:
        aggs += [F.count(F.when(col(c).isNull(), 1)).alias(f"{c}__m"), F.count(col(c)).alias(f"{c}__nn"),
                 (F.lit(None).cast("long") if rsd is None else F.approx_count_distinct(col(c), rsd)).alias(f"{c}__d")]
        if schema_kind(fields[c]) == "string":
            s = col(c).cast("string")
            aggs += [F.avg(F.length(s)).alias(f"{c}__len"),
                     F.avg(F.when(col(c).isNotNull(), F.try_to_timestamp(s).isNotNull().cast("double"))).alias(f"{c}__dt")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"{c}__len"), F.lit(None).cast("double").alias(f"{c}__dt")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"`{c}__m`").cast("long").alias("n_missing"),
        F.col(f"`{c}__d`").cast("long").alias("n_unique"), F.col(f"`{c}__nn`").cast("long").alias("n_non_null"),
        F.col(f"`{c}__len`").alias("avg_len"), F.col(f"`{c}__dt`").alias("date_share")) for i, c in enumerate(columns)])))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None,
                    with_samples: bool = True, approx_rsd: float | None = None) -> DataFrame:
    """One row per column: ordinal, column, spark_type, kind, n_missing, pct_missing,
    n_unique, n_non_null, avg_len, date_share (the last two for string columns), and
    sample_values.

    By default one scan counts every column's values (``_value_stats``), which gives all
    statistics exactly. With ``approx_rsd`` (0.05 recommended) one narrow aggregate gives
    them with HyperLogLog estimates of the distinct counts - for very wide or very large
    tables."""
    df = normalize_missing(df)
    columns = list(columns or df.columns)
    fields = {f.name: f for f in df.schema.fields}
    per_col = _value_stats(df, columns) if approx_rsd is None else _narrow_stats(df, columns, approx_rsd)
    of = lambda names: F.get(F.array(*[F.lit(x) for x in names]), F.col("ordinal"))
    per_col = per_col.withColumn("spark_type", of([fields[c].dataType.simpleString() for c in columns])).withColumn(
        "type_kind", of([schema_kind(fields[c].dataType) for c in columns]))
    kind = (F.when(F.col("n_non_null") == 0, F.lit("text"))
            .when(F.col("type_kind") != "string", F.col("type_kind"))
            .when(F.coalesce(F.col("date_share"), F.lit(0.0)) > DATE_SHARE, F.lit("datetime"))
            .when((F.col("n_unique") > TEXT_MIN_UNIQUE)
                  & (F.col("n_unique") / F.col("n_non_null") > TEXT_MIN_UNIQUE_SHARE)
                  & (F.col("avg_len") > TEXT_MIN_AVG_LEN), F.lit("text"))
            .otherwise(F.lit("categorical")))
    out = (per_col.select("ordinal", "column_name", "spark_type", kind.alias("kind"), "n_missing", _pct_missing().alias("pct_missing"),
                   "n_unique", "n_non_null", "avg_len", "date_share"))
    if with_samples:
        out = out.join(sample_values(df, columns=columns), "column_name", "left")
    return out


def kind_counts(profile: DataFrame) -> DataFrame:
    """(kind, n_columns, columns) from a profile (columns listed in table order)."""
    return profile.groupBy("kind").agg(
        F.count(F.lit(1)).cast("long").alias("n_columns"),
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda s: s["column_name"])
        .alias("columns"))


def missing_ranking(profile: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first; a placeholder row when none."""
    spark = profile.sparkSession
    ranked = (profile.filter(F.col("pct_missing") > 0)
              .select("column_name", "pct_missing", "ordinal"))
    placeholder = spark.createDataFrame([(NO_MISSING_LABEL, 0.0, -1)],
                                        "column_name string, pct_missing double, ordinal int")
    has_any = ranked.agg(F.count(F.lit(1)).alias("n"))
    fallback = placeholder.crossJoin(has_any).filter(F.col("n") == 0).drop("n")
    both = ranked.unionByName(fallback)
    w = Window.orderBy(F.col("pct_missing").desc(), F.col("ordinal"))
    return both.withColumn("rank", F.row_number().over(w).cast("long")).drop("ordinal")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name not in set(exclude)]


def quartile_map(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> dict[str, list[float]]:
    """Column -> [q1, q3] (linear interpolation). ``accuracy=None`` is exact, by counting
    and ranking distinct values (``functions.quantiles``); an integer switches to
    ``percentile_approx``. Columns without values are left out."""
    if accuracy is None:
        return quantile_map(df, columns, [0.25, 0.75])
    row = df.agg(*[F.percentile_approx(col(c).cast("double"), [0.25, 0.75], accuracy).alias(c) for c in columns]).first()
    return {c: [float(x) for x in row[c]] for c in columns if row[c] is not None}


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None,
                 accuracy: int | None = None) -> DataFrame:
    """(ordinal, column_name, q1, q3, lower, upper, n_outliers) per numeric column;
    0 outliers when iqr = 0. Two aggregate passes; the quartiles travel to the
    counting pass as literals (one number pair per column)."""
    df = normalize_missing(df)
    columns = list(columns) if columns is not None else numeric_columns(df)
    found = quartile_map(df, columns, accuracy)
    q = {c: tuple(found.get(c, (None, None))) for c in columns}
    aggs = []
    for c in columns:
        q1, q3 = q[c]
        if q1 is None or q3 == q1:
            aggs.append(F.lit(0).cast("long").alias(c))
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = col(c).cast("double")
        aggs.append(F.count(F.when((x < F.lit(lo)) | (x > F.lit(hi)), 1)).cast("long").alias(c))
    counts = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        q1, q3 = q[c]
        lo = None if q1 is None else q1 - 1.5 * (q3 - q1)
        hi = None if q1 is None else q3 + 1.5 * (q3 - q1)
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                             F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"),
                             F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper"),
                             col(c).alias("n_outliers")))
    return counts.select(F.inline(F.array(*rows)))
