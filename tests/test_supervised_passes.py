from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from tablesight.operators.supervised import train_and_select
from tablesight.plans.analysis import diagnose


def test_clean_table_is_persisted(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    d = diagnose(df, order_by=["id"])
    try:
        assert d.clean.is_cached and d.clean.count() == 60
    finally:
        d.clean.unpersist()
    assert not d.clean.is_cached


def test_scaler_is_fitted_once_and_nothing_stays_cached(spark, monkeypatch):
    fits = []
    plain = StandardScaler._fit
    monkeypatch.setattr(StandardScaler, "_fit", lambda self, data: fits.append(1) or plain(self, data))
    df = spark.range(200).select("id", (F.col("id") * 3 % 17).cast("double").alias("a"), (F.col("id") * 1.5).alias("y"))
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    res = train_and_select(df, "y", "id", forest_depth=3)
    assert res.status == "ok" and list(res.metrics) == ["Random Forest", "Regresion Lineal", "Gradient Boosting"]
    assert len(fits) == 1
    assert res.best_model == max(res.metrics, key=lambda m: res.metrics[m]["r2"])
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= before
    assert len(res.model.stages) == 2
