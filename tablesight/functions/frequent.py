"""The most frequent values, exactly, without shuffling every distinct value.

A mergeable frequent-items sketch (``approx_top_k``) over 64-bit value hashes picks at most
``TRACKED`` candidates in one pass; a second pass counts the candidates alone, so a task
sends at most that many rows. The counts then prove the answer or refute it: no other value can
have more rows than all candidates leave over, nor more than the sketch's error bound.
Where the k-th count is not above that, every value is counted in full. A collision
of hashes only adds a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

TRACKED = 8_192
#: Share of the rows that a value missing from the sketch's answer can have: twice the error
#: of a frequent-items sketch of this many items (3.5 over its map size), as values whose lower bound
#: is under the error are left out.
MISSED = 2 * 3.5 / TRACKED


def frequent_values(df: DataFrame, value: Column, k: int, tracked: int = TRACKED) -> tuple[DataFrame, int]:
    """((value, n) with the ``k`` most frequent non-null values as text, smallest first on equal
    counts, and the number of non-null values)."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(value.cast("string").alias("value")).filter("value IS NOT NULL")
    seen = rows.select(F.xxhash64("value").alias("h")).agg(
        F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(h, {tracked}, {tracked})").alias("top")).first()
    total, picked = seen["total"], [r["item"] for r in seen["top"] or []]  # at most ``tracked`` numbers
    hashes = df.sparkSession.createDataFrame([(h,) for h in picked], "__h long")
    counts = rows.join(F.broadcast(hashes), F.xxhash64("value") == F.col("__h"), "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.checkpoint()
    first = [r["n"] for r in counts.select("n").orderBy(F.desc("n")).limit(k).collect()]
    left_over = total - (counts.agg(F.sum("n")).first()[0] or 0)
    most = min(left_over, int(MISSED * TRACKED / tracked * total))
    if left_over and (len(first) < k or first[-1] <= most):
        counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k), total
