"""Table sources (A1-A3): read CSV/Parquet/JSON/ORC with one call.

A CSV file's encoding, separator and column types are decided from all its lines, each
by one distributed aggregate: UTF-8 unless some line is not valid UTF-8, the separator
that the most lines have as often as the header (quoted text left out), and the
narrowest type that all values of a column fit once the missing-value markers are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col

SEPARATORS = (",", ";", "\t", "|")   # fixed values of the reference, in its order
ENCODINGS = ("utf-8", "iso-8859-1")  # utf-8, then latin-1
PREVIEW_ROWS = 10
READERS = ("csv", "parquet", "json", "orc")
#: What a CSV cell is read as missing for.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_QUOTED = r'"([^"]|"")*"'
_WHOLE = r"^\s*[+-]?\d+\s*$"
_REAL = r"^\s*[+-]?((\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?|inf|Infinity)\s*$"
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """(separator, encoding, whether quoted cells hold line breaks), from all lines."""
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        return SEPARATORS[0], ENCODINGS[0], False
    bare = F.regexp_replace(F.col("value"), _QUOTED, "")

    def count(text: Column, sep: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))

    head = spark.range(1).select(F.lit(header[0]).alias("value")).select(*[count(bare, s).alias(str(i)) for i, s in enumerate(SEPARATORS)]).first()
    row = lines.agg(
        F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(count(F.col("value"), '"') % 2 == 1), F.lit(False)).alias("open"),
        *[F.count_if((F.col("value") != "") & (count(bare, s) == head[str(i)])).alias(f"s{i}") for i, s in enumerate(SEPARATORS)]).first()
    ranked = [(row[f"s{i}"], head[str(i)], -i) for i in range(len(SEPARATORS)) if head[str(i)] > 0]
    best = -max(ranked)[2] if ranked else 0
    return SEPARATORS[best], ENCODINGS[0 if row["utf8"] else 1], row["open"]


def infer_types(df: DataFrame) -> DataFrame:
    """String columns cast to boolean, long, double or timestamp where every non-null
    value fits (one aggregate over all columns); other columns stay strings."""
    names = df.columns
    checks = []
    for i, c in enumerate(names):
        v = col(c)
        tests = {"boolean": F.lower(v).isin("true", "false"), "long": F.rlike(v, F.lit(_WHOLE)) & F.trim(v).try_cast("long").isNotNull(),
                 "double": F.rlike(v, F.lit(_REAL)), "timestamp": F.rlike(v, F.lit(_DATE)) & v.try_cast("timestamp").isNotNull()}
        checks += [F.bool_and(F.when(v.isNotNull(), F.coalesce(t, F.lit(False)))).alias(f"{i}_{kind}") for kind, t in tests.items()]
    fits = df.agg(*checks).first()
    out = []
    for i, c in enumerate(names):
        kind = next((k for k in ("boolean", "long", "double", "timestamp") if fits[f"{i}_{k}"]), None)
        out.append(F.trim(col(c)).try_cast(kind).alias(c) if kind else col(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file with header: quotes doubled inside quotes, missing-value markers as
    null, then column types. Files without line breaks in cells are split over tasks."""
    sep, encoding, breaks = sniff_csv(spark, path)
    opts = {"header": True, "sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": breaks, **options}
    raw = spark.read.options(**opts).csv(path)
    if "schema" in options or str(opts.get("inferSchema", "")).lower() == "true":
        return raw
    return infer_types(raw.select(*[F.when(~F.trim(col(c)).isin(*MISSING), col(c)).alias(c) for c in raw.columns]))


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A1/A2: dispatch on the (lower-cased) extension; CSV gets header + inferred types."""
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind in ("xlsx", "xls"):
        raise NotImplementedError("Excel files are not read: export the sheet to CSV or Parquet")
    if kind in ("csv", "txt", "tsv"):
        return read_csv(spark, path, **options)
    if kind not in READERS:
        raise ValueError(f"unknown table format: {kind}")
    return spark.read.options(**options).format(kind).load(path)


def preview(df: DataFrame, order_by: Sequence[str], k: int = PREVIEW_ROWS) -> DataFrame:
    """A3 (a top-k report): the first ``k`` rows in ``order_by`` order."""
    return df.orderBy(*[col(c) for c in order_by]).limit(k)
