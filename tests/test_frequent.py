import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablesight.functions import frequent
from tablesight.operators.report import target_distribution


def brute(values, k):
    c = Counter(v for v in values if v is not None)
    return sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


def cases():
    rng = random.Random(4)
    zipf = [f"v{int(rng.paretovariate(0.9))}" for _ in range(6_000)] + [None] * 50
    return {"zipf": zipf, "all_different": [f"u{i}" for i in range(3_000)], "ties": ["b", "a", "c"] * 500 + [f"u{i}" for i in range(900)],
            "one_hot_long": ["x" * 100_000] * 60 + ["y"], "few": ["b", "a"], "nulls": [None, None], "none": []}


@pytest.mark.parametrize("name", cases())
@pytest.mark.parametrize("tracked", [16, 64, frequent.TRACKED])
def test_against_all_counts(spark, name, tracked):
    values = cases()[name]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    top, total = frequent.frequent_values(df, F.col("v"), 4, tracked)
    assert sorted(map(tuple, top.collect()), key=lambda x: (-x[1], x[0].encode())) == brute(values, 4)
    assert total == sum(v is not None for v in values)


def test_distribution_of_a_whole_table(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + [None]], "v string")
    got = [tuple(r) for r in target_distribution(df, "v", k=2).orderBy("rank").collect()]
    assert got == [("a", 5, 45.5, 1), ("b", 3, 27.3, 2)]
