import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.operators import bandit as H
from tablesight.operators import grounding as K


def test_number_normalisation_matches_python(spark):
    rng = np.random.default_rng(1)
    vals = ["12", "12,5", "0.15", "1.45", "1.25", "-3.0", "007", "2.05", "99.95", "-0.04", "0.25", "0.35", "1e3", "nan", "x", "", "123456789012345678"]
    vals += [str(round(v, int(k))) for v, k in zip(rng.uniform(-500, 500, 300), rng.integers(1, 6, 300))]
    vals += [f"{k / 20}" for k in range(1, 200)]

    def want(v):
        try:
            x = float(v.replace(",", "."))
        except ValueError:
            return v
        return v if x != x else str(int(x)) if x.is_integer() else f"{x:.1f}"

    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(K.normalize_number(F.col("v"))).collect()]
    assert got == [want(v) for v in vals]


def test_grounding_and_citations(spark):
    facts = spark.createDataFrame([("c1", 0.8473, None), ("c1", None, "Random Forest con 205 filas")],
                                  "context_id string, num_value double, str_value string")
    answers = spark.createDataFrame([
        (1, "c1", "Segun el Agente Supervisado, acierta 0.8 con 205 filas en 3 pasos"),
        (2, "c1", "Segun el Agente ETL hay 999 filas")], "answer_id long, context_id string, text string")
    out = {r["answer_id"]: r for r in K.ungrounded_numbers(answers, K.allowed_numbers(facts)).collect()}
    assert out[1]["valid"] and not out[2]["valid"] and out[2]["n_ungrounded"] == 1
    q = spark.createDataFrame([("¿Cual fue el mejor modelo?",), ("¿Cuantos clusters encontraron?",), ("hola",)], "q string")
    assert [r[0] for r in q.select(K.question_intent(F.col("q"))).collect()] == ["recomendacion", "clusters", "general"]
    assert answers.select(K.cites_source(F.col("text"))).first()[0]


def test_bandit_state_is_sum_of_updates_and_learns(spark):
    rng = np.random.default_rng(3)
    n = 2000
    x1 = rng.normal(size=n)
    label = (x1 > 0).astype(int)  # separable by the first feature
    rows = [(i, [float(x1[i]), float(rng.normal()), 1.0], int(label[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, x array<double>, label int")
    run = H.run_rounds(df, "k", "x", "label", 2, dim=3, n_rounds=8)
    rewards = run.rewards.toPandas()
    assert len(rewards) == n
    # the learned state is exactly the sum of the per-row updates
    X = np.array([r[1] for r in rows])
    arms = dict(zip(rewards["k"], rewards["arm"]))
    rew = dict(zip(rewards["k"], rewards["reward"]))
    for a in range(2):
        idx = [i for i in range(n) if arms[i] == a]
        Xa = X[idx]
        assert np.allclose(run.state.S[a], Xa.T @ Xa)
        assert np.allclose(run.state.b[a], Xa.T @ np.array([rew[i] for i in idx]))
    fw = H.final_window_reward(H.with_steps(run.rewards, ["round", "u"]), 2).first()
    assert fw["lift"] > 0.1
