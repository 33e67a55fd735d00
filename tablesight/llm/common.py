"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch to Python workers; texts can be long.
BATCH_ROWS, BATCH_BYTES = 1_024, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session sets a bound itself."""
    for key, default, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
                                ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(key, None) == default:  # Spark's default
            spark.conf.set(key, bound)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a scratch folder; a cluster without it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tablesight-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files: later
    steps neither recompute it nor depend on the executor that made it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back. Other than
    after ``cut``, a join on it shuffles anew, so that adaptive execution can split a very
    frequent key."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def refuse_clash(docs: DataFrame, added) -> None:
    """Operators of this subpackage that add columns refuse a table that already has one of
    that name (in any case), rather than overwrite it or return the name twice."""
    names = {c.lower() for c in added}
    clash = [c for c in docs.columns if c.lower() in names]
    if clash:
        raise ValueError(f"the table already has columns that this operator adds: {clash}")


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128-bit identity of a text as 32 hex digits."""
    return F.md5(text.cast("binary"))


def learn_rows(doc_id: Column) -> Column:
    """True where a row may be learnt from: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def frames(it: Iterator[pd.DataFrame], rows: int = 128) -> Iterator[pd.DataFrame]:
    """Arrow batches cut to at most ``rows`` rows, so that very long texts do not meet
    in one result batch."""
    for pdf in it:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i:i + rows]
    give_back()


def give_back() -> None:
    """At the end of a task: return freed memory to the system. Python workers serve many
    tasks, and their allocators would keep the largest amount that any task needed."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
