from pyspark.sql import functions as F

from tablesight.operators.features import NO_FEATURES, FeatureEncoder
from tablesight.plans.analysis import analyze


def test_encoder_skips_constant_and_wide_strings_and_falls_back(spark):
    rows = [(i, "const", f"id{i}", ["a", "b", None][i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, c string, w string, s string")
    enc = FeatureEncoder.fit(df, exclude=["k"])
    assert "c" not in enc.categories and "w" not in enc.categories      # E5: 1 value / 40 values
    assert enc.categories["s"] == ["a", "b", "nan"]                     # E4: missing is the 'nan' category
    only_text = FeatureEncoder.fit(df.select("c", "w"))
    out = only_text.transform(df.select("c", "w"))
    assert out.columns == [NO_FEATURES] and out.agg(F.max(NO_FEATURES)).first()[0] == 0.0   # E6


def test_failing_stage_becomes_a_status_row(spark):
    rows = [(i, float(i % 7), float((i * 3) % 11), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    # 'missing_key' does not exist: every approach fails on its own, and the run still
    # returns one status row per approach plus an 'empty' recommendation.
    res = analyze(df, key="missing_key", target="y", approaches=["supervised", "unsupervised"], goal="predecir")
    st = {r["approach"]: r["status"] for r in res.status.collect()}
    assert st == {"supervised": "failed", "unsupervised": "failed"}
    assert res.recommendation.first()["status"] == "empty"
    # without a target only clustering can run
    res2 = analyze(df, key="k", target=None, approaches=["supervised", "unsupervised"], goal="segmentar")
    st2 = {r["approach"]: r["status"] for r in res2.status.collect()}
    assert st2["supervised"] == "skipped" and st2["unsupervised"] == "ok"
    assert res2.recommendation.first()["winner"] == "unsupervised"


def test_report_of_a_run_and_invariance_to_the_domain(spark):
    """O2: facts and report come from the run; O5: the domain changes labels only."""
    from tablesight.operators.report import validate_report_json
    rows = [(i, float(i % 7), float((i * 3) % 11), float(i % 5) * 2 + 1) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, a double, b double, sales double")
    runs = [analyze(df, "k", None, ["unsupervised"], goal="segmentar", domain=d) for d in (None, "finanzas")]
    facts = [{(r["section"], r["key"]): (r["num_value"], r["str_value"]) for r in a.facts.collect()} for a in runs]
    assert facts[0][("etl", "n_rows")] == (80.0, None)
    assert facts[0][("no_supervisado", "best_k")][0] >= 2
    assert {k: v for k, v in facts[0].items() if k[1] != "goal_label"} == {k: v for k, v in facts[1].items() if k[1] != "goal_label"}
    assert [a.report.select(validate_report_json(F.col("report"))).first()[0] for a in runs] == [False, False]  # no finding without a target
    with_target = analyze(df, "k", "sales", ["unsupervised"], goal="segmentar")
    assert with_target.report.select(validate_report_json(F.col("report"))).first()[0]
    assert "clase" in {r["section"] for r in with_target.facts.collect()}
