"""Repeated rows found by hashes first.

Equal rows have equal hashes, so a row whose hash occurs once is alone. One pass counts
128-bit row hashes (16 bytes a row are shuffled, pre-aggregated); whole rows are grouped only
where their hash repeats. Whether few hashes repeat (then they are broadcast) or many is left
to adaptive execution, which knows their size. Hashes only choose the rows to compare: a
collision costs a comparison, never a row.

The input is read twice (``duplicates``) or three times (``distinct_rows``), so it must give
the same rows each time; persist it where it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

_H1, _H2 = "__row_hash_1", "__row_hash_2"


def _hashes(df: DataFrame) -> list[Column]:
    # a null leaves the hash as it is, so where the nulls are is hashed as well
    cols = [F.array(*[col(c).isNull() for c in df.columns]), *[col(c) for c in df.columns]]
    return [F.xxhash64(*cols).alias(_H1), F.xxhash64(F.lit(1), *cols).alias(_H2)]


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` with its row hashes, and the hashes that occur more than once."""
    hashed = df.select("*", *_hashes(df))
    repeated = df.select(*_hashes(df)).groupBy(_H1, _H2).agg(F.count(F.lit(1)).alias("__row_copies")).filter("__row_copies > 1").drop("__row_copies")
    return hashed, repeated


def duplicates(df: DataFrame) -> DataFrame:
    """One row: ``n_duplicates``, the rows beyond the first of each group of equal rows
    (nulls equal). A table without columns or rows has none."""
    if not df.columns:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_duplicates"))
    hashed, repeated = _split(df)
    same = hashed.join(repeated, [_H1, _H2], "left_semi").groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__row_copies"))
    return same.agg(F.coalesce(F.sum(F.col("__row_copies") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without the repetitions of equal rows (nulls equal)."""
    if not df.columns:
        return df.dropDuplicates()
    hashed, repeated = _split(df)
    alone = hashed.join(repeated, [_H1, _H2], "left_anti")
    same = hashed.join(repeated, [_H1, _H2], "left_semi").drop(_H1, _H2).dropDuplicates()
    return alone.select(*[col(c) for c in df.columns]).unionByName(same)
