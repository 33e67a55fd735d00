import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.operators import cluster as C
from tablesight.operators import metrics as M
from tablesight.sources.readers import read_table, sniff_csv
from tablesight.sources.sinks import write_report_text, write_table
from tablesight.streaming.stream_ops import StreamingBandit, clean_stream
from tests.conftest import SF_SMALL


def test_csv_sniffing_and_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="ts-csv-")
    p = os.path.join(d, "datos.csv")
    with open(p, "w", encoding="latin-1") as f:
        f.write("edad;ciudad;monto\n30;Bogotá;10,5\n41;Cali;7,25\n")
    assert sniff_csv(spark, p)[:2] == (";", "iso-8859-1")
    df = read_table(spark, p)
    assert df.columns == ["edad", "ciudad", "monto"]
    assert sorted(r["ciudad"] for r in df.collect()) == ["Bogotá", "Cali"]
    out = os.path.join(d, "out.parquet")
    write_table(df, out)
    assert read_table(spark, out).count() == 2
    rep = spark.createDataFrame([(2, "segunda"), (1, "primera")], "position int, line string")
    write_report_text(rep, os.path.join(d, "rep"))
    assert [r[0] for r in spark.read.text(os.path.join(d, "rep")).collect()] == ["primera", "segunda"]
    with pytest.raises(NotImplementedError):
        read_table(spark, "x.xlsx")


def test_macro_f1_and_auc_closed_form(spark):
    y = [0, 0, 1, 1, 2, 2, 2, 1]
    p = [0, 1, 1, 1, 2, 0, 2, 3]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    m = M.classification_metrics(df, "y", "p").first()
    classes = sorted(set(y) | set(p))
    f1s = []
    for c in classes:
        tp = sum(a == c and b == c for a, b in zip(y, p))
        fp = sum(a != c and b == c for a, b in zip(y, p))
        fn = sum(a == c and b != c for a, b in zip(y, p))
        f1s.append(0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
    assert m["f1_macro"] == pytest.approx(np.mean(f1s))
    assert m["accuracy"] == pytest.approx(np.mean(np.array(y) == np.array(p)))
    s = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5), (1, 0.2)], "y int, s double")
    # pairs: pos (0.9,0.5,0.2) vs neg (0.1,0.5): wins 2 + 1.5 + 1 = 4.5 of 6
    assert M.roc_auc(s, "y", "s").first()["auc"] == pytest.approx(4.5 / 6)


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (25, 3)), rng.normal(-4, 1, (20, 3))])
    lab = np.array([0] * 30 + [1] * 25 + [2] * 20)
    df = spark.createDataFrame([(i, X[i].tolist(), int(lab[i])) for i in range(len(X))], "k long, v array<double>, c int")
    got = C.silhouette(df, "v", "c").first()["silhouette"]
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), rel=1e-9)
    cents = C.cluster_stats(df, "v", "c")
    assigned = C.assign_nearest(df, "v", cents).select("cluster").toPandas()["cluster"].to_numpy()
    mu = np.array([c[2] for c in cents])
    assert (assigned == ((X[:, None, :] - mu[None]) ** 2).sum(-1).argmin(1)).all()


def test_streaming_clean_and_bandit(spark):
    from tablesight.operators.clean import CleaningPlan
    d = tempfile.mkdtemp(prefix="ts-stream-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    dirty = ev.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))
    plan = CleaningPlan.fit(dirty, order_by=["event_id"])
    src = os.path.join(d, "in")
    dirty.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(dirty.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = clean_stream(plan, stream).writeStream.format("memory").queryName("clean_events") \
        .option("checkpointLocation", os.path.join(d, "ck1")).start()
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT count(*) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS nulls FROM clean_events").first()
    assert out["n"] == dirty.count() and out["nulls"] == 0

    ctx = ev.select("event_id", F.array(F.col("value") / 100.0, F.lit(1.0)).alias("x"),
                    (F.col("event_type") == "click").cast("int").alias("label"))
    src2 = os.path.join(d, "in2")
    ctx.repartition(4).write.parquet(src2)
    bandit = StreamingBandit(spark, n_arms=2, dim=2, state_dir=os.path.join(d, "state"))
    s2 = spark.readStream.schema(ctx.schema).option("maxFilesPerTrigger", 1).parquet(src2)
    q2 = s2.writeStream.foreachBatch(bandit.foreach_batch).option("checkpointLocation", os.path.join(d, "ck2")).start()
    q2.processAllAvailable()
    q2.stop()
    assert bandit.state.S[:, -1, -1].sum() == pytest.approx(ctx.count())  # every row updated exactly one arm
    again = StreamingBandit(spark, n_arms=2, dim=2, state_dir=os.path.join(d, "state"))
    assert np.allclose(again.state.S, bandit.state.S)  # state resumes from the checkpoint folder


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 6 and "kind" in df.columns
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 120
