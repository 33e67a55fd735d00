"""A candidate that fails may not leave a result that looks whole."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegressionModel
from pyspark.sql import functions as F

from tablesight.operators import supervised
from tablesight.operators.supervised import train_and_select
from tablesight.plans import registry
from tablesight.plans.analysis import analyze


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(supervised, "N_TREES", 3)


def broken(*args, **kw):
    raise MemoryError("no room")


def parts(spark, d):
    spark.range(120).selectExpr("id as p_partkey", "id * 1.5 as p_retailprice", "cast(id % 7 as int) as p_size", "concat('b', id % 3) as p_brand").write.parquet(f"{d}/part.parquet")
    return d


def test_regressors_without_one_candidate(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(GBTRegressor, "_fit", broken)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    with pytest.raises(RuntimeError, match="Gradient Boosting: no room"):
        registry.queries()["fit_regressors"](spark, parts(spark, str(tmp_path)))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= before


def test_failed_scoring_and_predictions_without_score(spark, monkeypatch):
    df = spark.range(80).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 1.5).alias("y"))
    plain = LinearRegressionModel._transform
    monkeypatch.setattr(LinearRegressionModel, "_transform", lambda self, d: plain(self, d).withColumn("prediction", F.lit(float("nan"))))
    with pytest.raises(RuntimeError, match="Regresion Lineal: its predictions have no score"):
        train_and_select(df, "y", "id", candidates=["Regresion Lineal"])
    monkeypatch.setattr(LinearRegressionModel, "_transform", broken)
    with pytest.raises(RuntimeError, match="Regresion Lineal: no room"):
        train_and_select(df, "y", "id", candidates=["Regresion Lineal"])


def test_unknown_candidate(spark):
    df = spark.range(80).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 1.5).alias("y"))
    with pytest.raises(ValueError, match="Regresion Logistica"):
        train_and_select(df, "y", "id", candidates=["Regresion Lineal", "Regresion Logistica"])


def test_analysis_reports_the_failure(spark, monkeypatch):
    monkeypatch.setattr(GBTRegressor, "_fit", broken)
    df = spark.range(80).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 1.5).alias("y"))
    (row,) = analyze(df, "id", "y", ["supervised"], goal="predecir").status.collect()
    assert row["status"] == "failed" and "no room" in row["detail"] and row["score_norm"] == 0.0


def test_importances_without_one_candidate(spark, monkeypatch, tmp_path):
    """The importances are those of the best of all candidates, or none are returned."""
    monkeypatch.setattr(RandomForestClassifier, "_fit", broken)
    spark.range(120).selectExpr("id as doc_id", "cast(id % 2 as int) as quality").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(120).selectExpr("id as doc_id", "id % 31 as n_chars", "concat('l', id % 3) as lang", "concat('s', id % 2) as source").write.parquet(
        f"{tmp_path}/documents.parquet")
    with pytest.raises(RuntimeError, match="Random Forest: no room"):
        registry.queries()["feature_importance"](spark, str(tmp_path))


def test_no_importances_are_not_zeros(spark):
    class Plain:
        pass

    with pytest.raises(ValueError, match="Plain"):
        supervised.model_importances(PipelineModel(stages=[Plain()]), 2)
    with pytest.raises(ValueError):
        supervised.SupervisedResult("ok", feature_names=["a", "b"], importances=[1.0]).importance_table(spark)
