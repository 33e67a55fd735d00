"""What both classifiers share: a bounded labelled sample and a small logistic fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn_rows, text_or_empty


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int) -> pd.DataFrame:
    """At most ``bound`` labelled rows (half of them per class, by a hash of the id) as
    (text, y, weight). ``weight`` gives each class its share among all labelled rows.

    Only rows that may be learnt from are used; rows without a 0/1 label or an id are
    left out. The ids are picked from the label table alone, so the join broadcasts at
    most ``bound`` ids."""
    pool = (labels.select("doc_id", F.col(target).cast("int").alias("y"))
            .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn_rows(F.col("doc_id"))))
    totals = {r["y"]: r["n"] for r in pool.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = bound // 2
    ids = None
    for y in sorted(totals):
        part = pool.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(half)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return pd.DataFrame({"text": [], "y": [], "weight": []})
    rows = (docs.select("doc_id", text_or_empty().alias("text"))
            .join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id").select("text", "y").limit(bound).toPandas())
    share = rows["y"].map(rows["y"].value_counts())
    rows["weight"] = rows["y"].map(totals).astype(float) / share / max(1, sum(totals.values())) * len(rows)
    return rows.sort_values(["text", "y"], ignore_index=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 100) -> np.ndarray:
    """Weighted logistic regression with intercept (first coefficient, not penalised) by
    damped Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    pen = np.full(z.shape[1], l2)
    pen[0] = 1e-6
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (pen * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(z @ w)
        grad = z.T @ (weight * (p - y)) + pen * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        t = 1.0
        while loss(w - t * step) > now and t > 1e-6:
            t /= 2
        w, before, now = w - t * step, now, loss(w - t * step)
        if before - now < 1e-7 * (1 + abs(before)):
            break
    return w
