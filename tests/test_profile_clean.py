import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesight.functions.columns import adjusted_skew
from tablesight.operators import profile as P
from tablesight.operators.clean import CleaningPlan


def _classification_fixture(spark):
    # Shape of the reference's synthetic classification table: nulls and repeated rows.
    rows = []
    for i in range(200):
        ingreso = None if i % 13 == 0 else float(1000 + (i * 37) % 900 + (50000 if i == 7 else 0))
        ciudad = None if i % 25 == 0 else ["Bogota", "Cali", "Medellin"][i % 3]
        rows.append((float(18 + i % 50), ingreso, ciudad, i % 2))
    rows += rows[:5]
    return spark.createDataFrame(rows, "edad double, ingreso double, ciudad string, churn int")


def test_overview_and_profile(spark):
    df = _classification_fixture(spark)
    ov = P.overview(df).first()
    assert ov["n_rows"] == 205 and ov["n_cols"] == 4 and ov["n_duplicates"] == 5
    pdf = df.toPandas()
    assert ov["total_missing"] == int(pdf.isna().sum().sum())
    prof = {r["column_name"]: r for r in P.profile_columns(df).collect()}
    assert prof["ciudad"]["kind"] == "categorical"
    assert prof["edad"]["kind"] == "numeric"
    assert prof["ingreso"]["n_missing"] == int(pdf["ingreso"].isna().sum())
    assert prof["ingreso"]["pct_missing"] == round(100.0 * pdf["ingreso"].isna().sum() / len(pdf), 2)
    assert prof["ciudad"]["n_unique"] == pdf["ciudad"].nunique()
    assert prof["ciudad"]["sample_values"] == sorted(pdf["ciudad"].dropna().unique())[:5]


def test_iqr_outliers_matches_pandas(spark):
    df = _classification_fixture(spark)
    out = {r["column_name"]: r["n_outliers"] for r in P.iqr_outliers(df, ["edad", "ingreso"]).collect()}
    s = df.toPandas()["ingreso"].dropna()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    iqr = q3 - q1
    assert out["ingreso"] == int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())


def test_adjusted_skew_matches_pandas(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 10.0, 40.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.agg(adjusted_skew(F.col("x"))).first()[0]
    assert got == pytest.approx(pd.Series(vals).skew(), rel=1e-9)


def test_cleaning_plan_leaves_no_nulls(spark):
    df = _classification_fixture(spark)
    plan = CleaningPlan.fit(df, order_by=["edad"])
    clean = plan.transform(df)
    assert P.overview(clean).first()["total_missing"] == 0
    assert clean.count() == 200
    assert plan.impute["ciudad"][0] == "moda"
    assert plan.impute["ingreso"][0] in ("media", "mediana")
    # the 50000 outlier is clipped to the upper fence
    assert "ingreso" in plan.clip
    lo, hi, _ = plan.clip["ingreso"]
    assert clean.agg(F.max("ingreso")).first()[0] == pytest.approx(hi)


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "c string")
    plan = CleaningPlan.fit(df.withColumn("k", F.monotonically_increasing_id()))
    assert plan.impute["c"] == ("moda", "a")


def test_approximate_profile_agrees_on_counts_and_kinds(spark):
    from tests.conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    exact = {r["column_name"]: r for r in P.profile_columns(docs, with_samples=False).collect()}
    approx = {r["column_name"]: r for r in P.profile_columns(docs, approx_rsd=0.01).collect()}
    for c, r in exact.items():
        a = approx[c]
        assert (a["kind"], a["n_missing"], a["n_non_null"]) == (r["kind"], r["n_missing"], r["n_non_null"])
        assert abs(a["n_unique"] - r["n_unique"]) <= max(2, 0.05 * r["n_unique"])
        if r["spark_type"] == "string":
            assert abs(a["avg_len"] - r["avg_len"]) < 1e-6


def test_fixed_text_rounds_as_python_prints(spark):
    import random
    from tablesight.functions.columns import fixed_text
    rnd = random.Random(3)
    xs = [0.595, 0.125, 2.5, 1.005, -0.004, 0.0, 1e9 + 0.125, 0.045, -2.675] + [round(rnd.uniform(-50, 50), 3) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2, 4):
        got = [r[0] for r in df.select(fixed_text(F.col("x"), d)).collect()]
        assert got == [f"{x:.{d}f}" for x in xs]


def test_string_order_key_and_date_strings(spark):
    import datetime

    import pytest
    from tablesight.operators.clean import CleaningPlan
    day = lambda i: None if i % 5 == 2 else f"2024-01-{i + 1:02d}"
    rows = [(f"id{i:03d}", day(i), f"2023-02-{i % 28 + 1:02d}", float(i)) for i in range(25)]
    df = spark.createDataFrame(rows, "id string, gaps string, full string, x double").repartition(4)
    plan = CleaningPlan.fit(df, order_by=["id"])
    out = {r["id"]: r for r in plan.transform(df).collect()}
    want = None
    for i in range(25):
        want = day(i) or want
        assert out[f"id{i:03d}"]["gaps"] == datetime.datetime.fromisoformat(want)
        assert out[f"id{i:03d}"]["full"] == datetime.datetime.fromisoformat(rows[i][2])
    with pytest.raises(ValueError, match="order_by"):
        CleaningPlan.fit(df).transform(df)
