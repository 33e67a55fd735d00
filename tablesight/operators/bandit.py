"""Contextual bandit (H1-H8): LinUCB learned in batched rounds over a logged table.

The reference plays rows one at a time; here rows are dealt into rounds by a
hash of their key. Round ``r`` is scored with the state learned from rounds
``< r`` (arm = argmax theta_a.x + alpha sqrt(x' A_a^-1 x), lowest arm on ties), and
its updates are additive, so a round is one aggregate of per-arm sufficient
statistics (``sum x x'`` and ``sum r x``). Partial sums are computed per Arrow
batch with numpy (``mapInPandas``) and reduced by Spark; only ``arms x d x d``
numbers reach the driver, which inverts the matrices. Scoring is a narrow JVM
expression over literal per-arm matrices (no Python per row).

The round-partitioned input is written once to the cluster's checkpoint folder,
so every round reads only its own partition and the lineage is cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.ordered import global_row_number, running_sums
from ..functions.random import hash_uniform
from ..session import ensure_checkpoint_dir

ALPHA = 0.8
SEED = 42
N_ROUNDS = 10
MIN_WINDOW = 50
STRONG, MODERATE = 0.3, 0.1


@dataclass
class BanditState:
    n_arms: int
    dim: int
    S: np.ndarray = None      # (arms, d, d): sum of x x'
    b: np.ndarray = None      # (arms, d): sum of r x
    history: list = field(default_factory=list)

    def __post_init__(self):
        if self.S is None:
            self.S = np.zeros((self.n_arms, self.dim, self.dim))
        if self.b is None:
            self.b = np.zeros((self.n_arms, self.dim))

    def add(self, stats: pd.DataFrame) -> None:
        for r in stats.itertuples(index=False):
            if r.kind == "A":
                self.S[int(r.arm), int(r.idx) // self.dim, int(r.idx) % self.dim] += r.value
            else:
                self.b[int(r.arm), int(r.idx)] += r.value

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """A_a = I + S_a; returns (A_a^-1, theta_a = A_a^-1 b_a) for every arm."""
        A = self.S + np.eye(self.dim)[None, :, :]
        inv = np.linalg.inv(A)
        theta = np.einsum("aij,aj->ai", inv, self.b)
        return inv, theta


def sufficient_stats(df: DataFrame, arm: str, x: str, reward: str, dim: int) -> DataFrame:
    """H2: (arm, kind, idx, value) with kind 'A' = sum of x x' (idx = i*d + j) and
    kind 'b' = sum of reward * x (idx = i), per arm: one grouped sum of the products."""
    context = F.slice(F.transform(col(x), lambda v: v.cast("double")), 1, dim)
    products = F.concat(F.flatten(F.transform(context, lambda a: F.transform(context, lambda b: a * b))),
                        F.transform(context, lambda a: a * F.col("__r")))
    sums = df.select(col(arm).cast("int").alias("arm"), col(x), col(reward).cast("double").alias("__r")).groupBy("arm").agg(
        vector_to_array(Summarizer.sum(array_to_vector(products))).alias("s"))
    rows = sums.select("arm", F.posexplode("s").alias("at", "value"))
    return rows.select("arm", F.when(F.col("at") < dim * dim, "A").otherwise("b").alias("kind"),
                       (F.col("at") - F.when(F.col("at") < dim * dim, 0).otherwise(dim * dim)).cast("int").alias("idx"), "value")


def _dot_lit(x: Column, v: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(t)) for t in v]), lambda a, b: a * b),
                       F.lit(0.0), lambda s, t: s + t)


def choose_arm(x: Column, inv: np.ndarray, theta: np.ndarray, alpha: float = ALPHA) -> Column:
    """H1: LinUCB arm for context ``x`` (array<double>); lowest arm on ties."""
    cands = []
    for a in range(theta.shape[0]):
        mean = _dot_lit(x, theta[a])
        ax = F.array(*[_dot_lit(x, inv[a][i]) for i in range(inv.shape[1])])
        quad = F.aggregate(F.zip_with(x, ax, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        p = mean + F.lit(alpha) * F.sqrt(F.greatest(quad, F.lit(0.0)))
        cands.append(F.struct((-p).alias("neg"), F.lit(a).alias("arm")))
    return F.array_min(F.array(*cands))["arm"]


def with_intercept(x: Column) -> Column:
    """Add the constant 1 as the last context feature."""
    return F.concat(x, F.array(F.lit(1.0)))


@dataclass
class BanditRun:
    rewards: DataFrame          # key, round, u, arm, reward
    state: BanditState
    n_arms: int
    final: Row | None = None    # its row of ``final_window_reward``, once computed


def run_rounds(df: DataFrame, key: str, x: str, label: str, n_arms: int, dim: int,
               alpha: float = ALPHA, n_rounds: int = N_ROUNDS, seed: int = SEED,
               workdir: str | None = None) -> BanditRun:
    """H3/H4: batched LinUCB; every row is played once, in rounds dealt by md5(key)."""
    spark = df.sparkSession
    u = hash_uniform(col(key), F.lit("round"), F.lit(str(seed)))
    staged = df.select(col(key).alias("__key"), col(x).alias("__x"), col(label).cast("int").alias("__y"),
                       u.alias("__u")).withColumn("__round", F.floor(F.col("__u") * n_rounds).cast("int"))
    path = (workdir or ensure_checkpoint_dir(spark)).rstrip("/") + f"/bandit-{uuid.uuid4().hex}"
    staged.write.mode("overwrite").partitionBy("__round").parquet(path)
    table = spark.read.parquet(path)
    state = BanditState(n_arms, dim)
    parts = []
    for r in range(n_rounds):
        inv, theta = state.solve()
        scored = (table.filter(F.col("__round") == r)
                  .withColumn("__arm", choose_arm(F.col("__x"), inv, theta, alpha))
                  .withColumn("__reward", (F.col("__arm") == F.col("__y")).cast("double")))
        state.add(sufficient_stats(scored, "__arm", "__x", "__reward", dim).toPandas())
        state.history.append(r)
        parts.append(scored.select(F.col("__key").alias(key), F.col("__round").alias("round"),
                                   F.col("__u").alias("u"), F.col("__arm").alias("arm"),
                                   F.col("__reward").alias("reward")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return BanditRun(out, state, n_arms)


def with_steps(rewards: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Step number 1..n in play order (range-bucketed, no single-task window)."""
    return global_row_number(rewards, order_by, name="step", start=1)


def final_window_reward(stepped: DataFrame, n_arms: int) -> DataFrame:
    """H5/H6: mean reward over the last max(50, n//5) steps, the 1/arms baseline, the
    lift and its band."""
    n = stepped.count()
    j = stepped.withColumn("n", F.lit(n).cast("long")).withColumn(
        "w", F.greatest(F.lit(MIN_WINDOW), F.floor(F.col("n") / 5)).cast("long"))
    a = j.filter(F.col("step") > F.col("n") - F.col("w")).agg(
        F.first("n").alias("n_steps"), F.first("w").alias("window"), F.avg("reward").alias("final_reward"))
    base = 1.0 / n_arms
    lift = F.col("final_reward") - F.lit(base)
    return a.select(F.col("n_steps").cast("long"), "window", "final_reward", F.lit(base).alias("baseline"),
                    lift.alias("lift"),
                    F.when(lift > STRONG, F.lit("fuerte")).when(lift > MODERATE, F.lit("moderada"))
                    .otherwise(F.lit("leve")).alias("quality"))


def reward_curve(stepped: DataFrame) -> DataFrame:
    """H7: cumulative mean reward by step (range-bucketed running sum)."""
    c = running_sums(stepped.select("step", "reward"), ["step"], {"cum": F.col("reward")})
    return c.select("step", (F.col("cum") / F.col("step")).alias("cum_mean"))
