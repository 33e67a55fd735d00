"""Structured Streaming forms of the operators that make sense on a stream.

* ``clean_stream``: the row-local part of a fitted ``CleaningPlan`` (drop sparse
  columns, constant imputation with the fitted values, winsorising with the
  fitted fences) - a stateless projection, valid on any stream.
* ``dedupe_stream``: exact duplicate removal bounded by a watermark.
* ``StreamingBandit``: the LinUCB update as ``foreachBatch``: each micro-batch
  is scored with the state of the previous batches, its sufficient statistics
  are added, and the state is written to the checkpoint folder keyed by batch
  id, so a restarted query resumes and a replayed batch is not counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bandit as H
from ..operators.clean import METHOD_FFILL, CleaningPlan
from .fill import fill_stream


def clean_stream(plan: CleaningPlan, stream: DataFrame, event_time: str | None = None, group_by: Sequence[str] = (),
                 tie_keys: Sequence[str] = (), delay: str = "10 minutes", leading_wait_seconds: float | None = None) -> DataFrame:
    out = plan.transform_stream(stream)
    gaps = [c for c, (method, _) in plan.impute.items() if method == METHOD_FFILL]
    if event_time is None or not gaps:
        return out
    return fill_stream(out, gaps, event_time, group_by, tie_keys, delay, leading_wait_seconds)


def dedupe_stream(stream: DataFrame, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Drop exact duplicates that arrive within the watermark delay of each other."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark()


class StreamingBandit:
    """LinUCB state updated once per micro-batch (``foreachBatch``)."""

    def __init__(self, spark, n_arms: int, dim: int, state_dir: str,
                 alpha: float = H.ALPHA, x: str = "x", label: str = "label"):
        """``state_dir``: a stable folder that all executors share; a later session with
        the same folder goes on from its last batch."""
        self.spark = spark
        self.n_arms, self.dim, self.alpha, self.x, self.label = n_arms, dim, alpha, x, label
        self.state_dir = state_dir.rstrip("/")
        self.state = H.BanditState(n_arms, dim)
        self.last_batch = -1
        self._load()

    def _slot(self, batch_id: int) -> str:
        """Two slots take turns, so the last complete snapshot survives a failed write."""
        return f"{self.state_dir}/state/slot{batch_id % 2}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _load(self) -> None:
        """The newer of the two snapshots; nothing where none was written. Read errors are raised."""
        snaps = [self.spark.read.parquet(p).toPandas() for p in map(self._slot, (0, 1)) if self._exists(p)]
        snaps = [s for s in snaps if len(s) == self.n_arms * (self.dim * self.dim + self.dim)]
        if not snaps:
            return
        snap = max(snaps, key=lambda s: s["batch_id"].max())
        self.state = H.BanditState(self.n_arms, self.dim)
        self.state.add(snap[["arm", "kind", "idx", "value"]])
        self.last_batch = int(snap["batch_id"].max())

    def _save(self, batch_id: int) -> None:
        rows = []
        for a in range(self.n_arms):
            rows += [(batch_id, a, "A", k, float(v)) for k, v in enumerate(self.state.S[a].ravel())]
            rows += [(batch_id, a, "b", k, float(v)) for k, v in enumerate(self.state.b[a])]
        df = self.spark.createDataFrame(rows, "batch_id long, arm int, kind string, idx int, value double")
        df.write.mode("overwrite").parquet(self._slot(batch_id))

    def foreach_batch(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch:
            return  # replayed after a restart: already applied
        inv, theta = self.state.solve()
        scored = (batch.withColumn("__arm", H.choose_arm(F.col(self.x), inv, theta, self.alpha))
                  .withColumn("__reward", (F.col("__arm") == F.col(self.label).cast("int")).cast("double")))
        stats = H.sufficient_stats(scored, "__arm", self.x, "__reward", self.dim).toPandas()
        self.state.add(stats)
        self.last_batch = batch_id
        self._save(batch_id)

    def theta(self) -> np.ndarray:
        return self.state.solve()[1]
