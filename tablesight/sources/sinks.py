"""Sinks (A4/A5): every operator returns a DataFrame; these write them out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_report_text(report: DataFrame, path: str, order_by: str = "position",
                      text: str = "line") -> None:
    """A4: a report table (position, line) as a text file, one line per row, in order.
    A table of more than one partition gives several part files, in order of their names."""
    report.orderBy(order_by).select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)
