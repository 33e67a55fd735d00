"""Exact quantiles against ``percentile`` and numpy, with brackets that hold, that are open and that fail."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.functions import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 1.0]


def rows_of(n=6_000):
    """A hot group, a group of ties, a null key, groups of one and two values, nulls, repeated rows."""
    rnd = random.Random(7)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", rnd.gauss(0, 100), float(i % 4), rnd.choice([None, 1.5, -2.0])) for i in range(n)]
    rows += [("one", 5.0, 1.0, None), ("two", 5.0, 1.0, None), ("two", 9.0, -1e300, None), ("none", None, None, None)] + [("hot", 3.25, 2.0, 1.5)] * 40
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(), "g string, x double, y double, z double").repartition(6).cache()


def close(a, b):
    return len(a) == len(b) and all(abs(x - y) <= 1e-9 * max(1.0, abs(x)) for x, y in zip(a, b))


@pytest.mark.parametrize("small, accuracy, ranked", [(10_000, 1_000, 1_000_000), (50, 100, 1_000_000), (1, 60, 10)])
def test_whole_table(table, monkeypatch, small, accuracy, ranked):
    for name, value in (("SMALL", small), ("ACCURACY", accuracy), ("RANKED", ranked)):
        monkeypatch.setattr(Q, name, value)
    got = Q.quantile_map(table, ["x", "y", "z"], PROBS)
    exact = table.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in PROBS])).alias(c) for c in "xyz"]).first()
    assert all(close(got[c], exact[c]) for c in "xyz")
    assert Q.quantile_map(table.filter("g = 'none'"), ["x"], PROBS) == {} == Q.quantile_map(table.limit(0), ["x"], PROBS)


@pytest.mark.parametrize("small, accuracy", [(10_000, 1_000), (50, 100), (1, 60)])
def test_groups(table, monkeypatch, small, accuracy):
    monkeypatch.setattr(Q, "SMALL", small)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    got = {(r.g, r.column_name): (r.n, r.q) for r in Q.column_quantiles(table, ["x", "y", "z"], PROBS, ["g"]).collect()}
    exact = table.groupBy("g").agg(*[F.struct(F.count(c).alias("n"), F.percentile(c, F.array(*[F.lit(p) for p in PROBS])).alias("q")).alias(c) for c in "xyz"])
    expected = {(r.g, c): r[c] for r in exact.collect() for c in "xyz" if r[c].n}
    assert got.keys() == expected.keys()
    assert all(got[k][0] == e.n and close(got[k][1], e.q) for k, e in expected.items())


def test_wrong_brackets_are_noticed(table, monkeypatch):
    """Whatever the sketch gives, the result is exact."""
    monkeypatch.setattr(Q, "SMALL", 10)
    monkeypatch.setattr(Q, "_margins", lambda probs: [x for p in probs for x in (min(1.0, p + 0.2), min(1.0, p + 0.3))])
    exact = table.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
    assert close(Q.quantile_map(table, ["x"], [0.25, 0.5])["x"], exact)
    groups = {r.g: r.q for r in Q.column_quantiles(table, ["x"], [0.25, 0.5], ["g"]).collect()}
    for r in table.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect():
        assert r.q is None or close(groups[r.g], r.q)


def test_special_numbers(spark):
    values = [math.inf, -math.inf, 0.0, -0.0, 1e300, -1e300, float("nan")] + [float(i) for i in range(30)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = Q.quantile_map(df, ["x"], [0.0, 0.5, 1.0])["x"]
    assert got[0] == -math.inf and got[1] == np.quantile([v for v in values if v == v] + [math.inf], 0.5) and math.isnan(got[2])


def test_what_is_shuffled(table, monkeypatch):
    """Inside a bracket lie few values, also of a column without ties."""
    monkeypatch.setattr(Q, "SMALL", 100)
    kept = []
    monkeypatch.setattr(Q, "_stored", lambda df: kept.append(df.persist()) or kept[-1])
    Q.group_quantiles(table, ["x"], [0.5], ["g"]).collect()
    inside = kept[1].filter("part >= 0").groupBy("__k").count().agg(F.max("count")).first()[0]
    assert inside <= max(100, 0.02 * table.count())
