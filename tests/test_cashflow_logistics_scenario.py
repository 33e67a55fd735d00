import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesight.operators import cashflow as CF
from tablesight.operators import logistics as L
from tablesight.operators import scenario as N
from tablesight.operators.supervised import train_and_select


def test_zero_variance_npv_equals_closed_form_and_irr_root(spark):
    # capital 100000, 12 periods, rate 0.01, inflow 15000, outflow 8000, std 0 (reference smoke test)
    proj = CF.Projection(capital=100000.0, horizon=12, discount_rate=0.01)
    params = spark.createDataFrame([("s", 15000.0, 0.0, 8000.0, 0.0, None, 15000.0)],
                                   "segment string, inflow_mean double, inflow_std double, outflow_mean double, "
                                   "outflow_std double, rate double, inflow_mean_adj double")
    ents = spark.range(500).select(F.lit("s").alias("seg"), F.col("id").alias("path"))
    paths = CF.simulate_paths(params, ents, "seg", "path", proj)
    npv = CF.npv_by_path(paths, proj)
    expected = -100000.0 + sum(7000.0 / 1.01 ** t for t in range(1, 13))
    assert npv.agg(F.max(F.abs(F.col("npv") - expected))).first()[0] < 1e-6
    irr = CF.irr_by_group(CF.mean_net_by_period(paths), proj).select(
        "irr", CF.npv_at(F.col("cashflows"), F.col("irr")).alias("z")).first()
    assert abs(irr["z"]) < 1e-3
    assert CF.prob_negative(npv).first()["prob_negative"] == 0.0
    bal = CF.running_balance(paths, proj).filter("period = 12").agg(F.max("balance")).first()[0]
    assert bal == pytest.approx(100000.0 + 12 * 7000.0)


def test_traceable_parameters(spark):
    pdf = pd.DataFrame({"monto": [-120.5, 300.0, 410.0, -80.0, 55.5, 1000.0], "churn": [1, 0, 0, 1, 0, 0]})
    df = spark.createDataFrame(pdf)
    d = CF.derive_distribution(df, "monto").first()
    assert d["mean"] == pytest.approx(pdf.monto.mean(), abs=1e-9)
    assert d["std"] == pytest.approx(pdf.monto.std(ddof=1), abs=1e-9)
    s = CF.split_flows(df, "monto").first()
    assert s["mode"] == "split_por_signo"
    assert s["inflow_mean"] == pytest.approx(pdf.monto[pdf.monto > 0].mean())
    assert s["outflow_mean"] == pytest.approx(pdf.monto[pdf.monto < 0].abs().mean())
    assert CF.binary_rate(df, "churn").first()["rate"] == pytest.approx(pdf.churn.mean())
    words = spark.createDataFrame([("si",), ("no",), ("si",), ("no",), ("no",)], "t string")
    assert CF.binary_rate(words, "t").first()["rate"] == pytest.approx(0.4)


def test_reorder_point_is_p20_and_no_invented_coordinates(spark):
    stock = np.array([5, 40, 13, 99, 7, 60, 22, 31, 1, 70], dtype=float)
    df = spark.createDataFrame([(float(s), ["norte", "sur", "centro", "oriente", "x"][i % 5]) for i, s in enumerate(stock)],
                               "stock double, ruta string")
    rop = L.reorder_point(df, "stock").first()
    assert rop["rop"] == pytest.approx(np.percentile(stock, 20), abs=1e-9)
    coords = spark.createDataFrame([("oriente", 4.14, -73.63), ("sur", 1.21, -77.28), ("centro", 4.71, -74.07),
                                    ("norte", 10.96, -74.79), ("nada", 0.0, 0.0)], "location string, lat double, lon double")
    routes = L.route_coordinates(df, "ruta", coords)
    assert routes.count() == 8  # the 'x' rows have no coordinates and are dropped
    assert [r[0] for r in L.unmapped_locations(df, "ruta", coords).collect()] == ["x"]


def test_whatif_monotone_and_quadrants_equal_clusters(spark):
    rng = np.random.default_rng(0)
    ingreso = rng.uniform(100, 1000, 300)
    pdf = pd.DataFrame({"rid": np.arange(300), "ingreso": ingreso, "otra": rng.normal(size=300),
                        "precio": 500 + 10 * ingreso + rng.normal(scale=5, size=300)})
    df = spark.createDataFrame(pdf)
    res = train_and_select(df, "precio", "rid", candidates=["Regresion Lineal"])
    base = N.baseline_row(df.drop("rid"), "precio")
    scen = spark.createDataFrame([("min", "ingreso", float(ingreso.min())), ("max", "ingreso", float(ingreso.max()))],
                                 "scenario string, column_name string, value double")
    rows = N.scenario_rows(base, scen).withColumn("rid", F.lit(0))
    pred = {r["scenario"]: r["raw_prediction"] for r in N.score_scenarios(res.model, res.encoder, rows).collect()}
    assert pred["max"] > pred["min"]
    seg = df.withColumn("cluster", (F.col("rid") % 4).cast("int"))
    q = N.bcg_quadrants(seg, "cluster", "ingreso", "otra")
    assert q.count() == 4


def test_scenarios_with_unknown_columns_bad_values_and_no_model(spark):
    base = spark.createDataFrame([(1.5, "a", 3.0)], "x double, s string, y double")
    sc = spark.createDataFrame([("only unknown", "nope", "1"), ("mixed", "x", "9"), ("mixed", "y", "not a number")],
                               "scenario string, column_name string, value string")
    rows = {r["scenario"]: (r["x"], r["s"], r["y"]) for r in N.scenario_rows(base, sc).collect()}
    assert rows == {"only unknown": (1.5, "a", 3.0), "mixed": (9.0, "a", 3.0)}
    bad = {(r["scenario"], r["reason"]) for r in N.bad_overrides(base, sc).collect()}
    assert bad == {("only unknown", "column"), ("mixed", "value")}
    assert {r["status"] for r in N.score_scenarios(None, None, N.scenario_rows(base, sc)).collect()} == {"unavailable"}
    assert N.quadrant_axes(base, "y") == ("x", "x")
