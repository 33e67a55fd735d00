"""Flagship query: profile the dirty events table, fit and apply the cleaning plan,
and return one row per column with its profile, planned action and cleaned state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.clean import CleaningPlan
from .tables import dirty_events


def diagnose_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dirty_events(spark, sf_dir)
    plan = CleaningPlan.fit(raw, order_by=["event_id"])
    cleaned = plan.transform(raw)
    before = P.profile_columns(raw, with_samples=False).select(
        "ordinal", "column_name", "kind", "n_missing", "pct_missing", "n_unique")
    after = P.profile_columns(cleaned, with_samples=False).select(
        "column_name", F.col("n_missing").alias("n_missing_after"), F.col("n_unique").alias("n_unique_after"))
    actions = plan.plan_table(spark).filter(F.col("column_name").isNotNull()).groupBy("column_name").agg(
        F.array_join(F.collect_list("action"), "; ").alias("actions"))
    return (before.join(after, "column_name", "left").join(actions, "column_name", "left")
            .orderBy("ordinal"))
