import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tablesight.functions.ordered import fill_forward_backward
from tablesight.functions.repeats import distinct_rows, duplicates
from tablesight.streaming.fill import GroupFill, fill_stream

ROWS = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (None, None, None), (None, None, None), (None, None, None), (2, 2, "b")]


@pytest.mark.parametrize("rows", [ROWS, ROWS * 400, [], [(5, 5, "x")] * 900])
def test_repeated_rows(spark, rows):
    df = spark.createDataFrame(rows, "n long, __n long, `a b` string")
    assert duplicates(df).first()[0] == len(rows) - len(set(rows))
    got = [tuple(r) for r in distinct_rows(df).collect()]
    assert len(got) == len(set(got)) and set(got) == set(rows)


def test_signed_zero_and_nan_are_equal(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert duplicates(df).first()[0] == df.count() - df.dropDuplicates().count() == 2
    assert distinct_rows(df).count() == 2


def test_hash_collisions_lose_no_row(spark, monkeypatch):
    from tablesight.functions import repeats
    monkeypatch.setattr(repeats, "_hashes", lambda df: [F.lit(7).alias("__row_hash_1"), F.lit(7).alias("__row_hash_2")])
    df = spark.createDataFrame(ROWS, "a long, b long, c string")
    assert duplicates(df).first()[0] == 3
    assert {tuple(r) for r in distinct_rows(df).collect()} == set(ROWS)


def test_group_fill_waits_for_the_watermark():
    g = GroupFill([0])
    g.open = [[30, [], [None]], [10, [], [None]], [20, [], ["x"]]]
    assert g.advance(10, None) == [] and len(g.leading) == 1
    again = GroupFill([0], g.dump())
    assert again.advance(20, None) == [["x"], ["x"]]
    assert again.advance(30, None) == [["x"]]
    tired = GroupFill([0])
    tired.open = [[10, [], [None]]]
    assert tired.advance(12, 5) == [] and tired.next_time(5) == 15 and tired.advance(15, 5) == [[None]]


def test_stream_fill_equals_batch_fill_with_a_restart(spark):
    d = tempfile.mkdtemp(prefix="ts-fill-")
    start = dt.datetime(2024, 1, 1)
    big = 2 ** 53 + 1
    rows = []
    for i in range(240):
        g = None if i % 11 == 0 else ("hot" if i % 3 else "cold")
        rows.append((i // 2, big + i, start + dt.timedelta(seconds=20 * (i // 2)), g, None if i % 5 else big * 3 + i,
                     None if i < 60 or i % 4 else start + dt.timedelta(days=i, microseconds=i)))
    schema = "row_no long, id long, at timestamp, grp string, n long, seen timestamp"
    df = spark.createDataFrame(rows, schema)
    # rows out of order inside the delay; the last file moves the watermark past all of them
    parts = [[r for r in rows if (r[0] * 20 + (r[1] % 3) * 100) // 900 == k] for k in range(4)]
    assert sum(map(len, parts)) == len(rows)
    end = [(-1, -1, start + dt.timedelta(days=9), "end", 1, start)]
    src, ck, out = (os.path.join(d, x) for x in ("in", "ck", "out"))

    def run(batches):
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).parquet(src)
            filled = fill_stream(stream, ["n", "seen"], "at", ["grp"], ["id"], "15 minutes")
            q = filled.writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).outputMode("append").start()
            q.processAllAvailable()
            q.stop()  # every batch goes to a restarted query

    run([*parts, end])
    got = spark.read.schema(schema).parquet(out).filter("id >= 0")
    want = fill_forward_backward(df, ["n", "seen"], ["at", "id"], ["grp"])
    assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, want.select(*df.columns).collect()))


def test_stream_fill_of_a_plan(spark):
    from tablesight.operators.clean import CleaningPlan, METHOD_FFILL
    from tablesight.streaming.stream_ops import clean_stream
    d = tempfile.mkdtemp(prefix="ts-fill-")
    schema = "id long, at timestamp, grp string, day date"
    day = dt.datetime(2024, 5, 1)
    rows = [(i, day + dt.timedelta(seconds=i), "a", day.date() if i % 2 else None) for i in range(10)] + [(99, day + dt.timedelta(days=3), "z", day.date())]
    spark.createDataFrame(rows, schema).write.parquet(os.path.join(d, "in"))
    plan = CleaningPlan(columns=["id", "at", "grp", "day"], kinds={"day": "datetime"}, pct_missing={}, n_rows_before=0, n_duplicates=0,
                        drop_columns=[], impute={"day": (METHOD_FFILL, None)}, order_by=["at"])
    q = clean_stream(plan, spark.readStream.schema(schema).parquet(os.path.join(d, "in")), "at", ["grp"]).writeStream.format("memory").queryName(
        "filled_days").option("checkpointLocation", os.path.join(d, "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT id, day FROM filled_days WHERE grp = 'a'").collect()
    assert sorted(r.id for r in got) == list(range(10)) and all(r.day == day.date() for r in got)
