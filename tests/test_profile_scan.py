"""The exact profile reads its table once and counts values of every type."""

import datetime as dt
import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from tablesight.operators import profile as P
from tablesight.operators import tags as TG
from tablesight.operators import vocabulary as V

LONG = "a text that is clearly longer than forty-eight characters, so it is hashed"
SCHEMA = ("k long, f float, d double, m decimal(10,2), b boolean, day date, at timestamp, local timestamp_ntz, "
          "s string, words array<string>, raw binary, none string")


def _rows():
    day, at = dt.date(2020, 2, 29), dt.datetime(2020, 2, 29, 1, 2, 3, 4)
    return [
        (1, 0.1, 0.0, Decimal("1.10"), True, day, at, at, LONG, ["a", "b"], b"x", None),
        (1, 0.1, -0.0, Decimal("1.1"), False, day, at, at, LONG, ["a", "b"], b"x", None),
        (2, float("nan"), float("nan"), Decimal("2"), None, None, None, None, hashlib.sha256(LONG.encode()).hexdigest(), [], b"", None),
        (0, 0.0, float("inf"), None, True, dt.date(1969, 12, 31), dt.datetime(1969, 12, 31), None, "", None, None, None),
        (None, None, None, None, None, None, None, None, " 2020-02-29 01:02:03" + " " * 40, [LONG], None, None),
        (None, None, -0.0, None, None, None, None, None, None, None, None, None),
    ]


def test_values_of_every_type(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    got = {r["column_name"]: r for r in P.profile_columns(df, with_samples=False).collect()}
    plain = P.normalize_missing(df)
    for i, c in enumerate(df.columns):
        values = [r[0] for r in plain.select(F.col(c).cast("string")).collect()]
        there = [v for v in values if v is not None]
        r = got[c]
        assert (r["ordinal"], r["n_missing"], r["n_non_null"], r["n_unique"]) == (i, len(values) - len(there), len(there), len(set(there))), c
        if c in ("s", "words", "raw"):
            assert r["avg_len"] == sum(map(len, there)) / len(there)
        else:
            assert r["avg_len"] is None and r["date_share"] is None
    assert got["s"]["date_share"] == 1 / 5 and got["none"]["kind"] == "text" and got["d"]["n_unique"] == 3


def test_empty_table(spark):
    got = P.profile_columns(spark.createDataFrame([], SCHEMA), with_samples=False).orderBy("ordinal").collect()
    assert [r["column_name"] for r in got] == spark.createDataFrame([], SCHEMA).columns
    assert all(r["n_missing"] == r["n_non_null"] == r["n_unique"] == 0 and r["pct_missing"] == 0.0 and r["kind"] == "text" for r in got)


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan")


def test_one_scan_for_each_table(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert _scans(P.profile_columns(df, with_samples=False)) == 1
    tables = {"one": df, "two": df.select("k", "s")}
    targets = TG.suggest_target(TG.name_catalog(tables), V.rules_frame(spark))
    out = TG.applicable_analyses(TG.column_catalog(tables), targets)
    assert _scans(out) == 2 and {r["table_name"]: r["n_rows"] for r in out.collect()} == {"one": 6, "two": 6}


def test_targets_that_are_absent_or_repeat(spark):
    cat = TG.categorical_like(spark.createDataFrame(
        [("t", 0, "a", "numeric", "numeric", 50, 30), ("t", 1, "b", "categorical", "string", 50, 3), ("u", 0, "a", "numeric", "numeric", 50, 30), (None, 0, "a", "numeric", "numeric", 50, 30)],
        "table_name string, ordinal int, column_name string, kind string, type_class string, n_rows long, n_unique long"))
    targets = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "b"), ("t", "gone"), (None, "a")], "table_name string, target_column string")
    got = [(r["table_name"], r["target_column"], r["task"]) for r in TG.applicable_analyses(cat, targets).collect()]
    assert sorted(got, key=str) == sorted([("t", "a", "regresion"), ("t", "b", "clasificacion"), ("t", "b", "clasificacion"),
                                           ("t", "gone", None), ("u", None, None), (None, None, None)], key=str)
