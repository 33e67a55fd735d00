import re

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tablesight.llm.common import table
from tablesight.llm.queries import QUERIES

from llm_rows import DOC_SCHEMA, ODD_ROWS

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(names) == set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op2_embedding_near_dedup",)])
def test_query_returns_every_document(spark, name):
    out = QUERIES[name](spark, SF)
    n = table(spark, SF, "documents").count()
    assert out.select("doc_id").distinct().count() == n


def test_pipeline_stages(spark, tmp_path):
    base = table(spark, SF, "documents")
    plant = "this passage of many words was written once and then it was copied into two documents so that a filter would find it " * 3
    extra = [(900001, "alpha beta gamma " + plant + " first end of a text"), (900002, "delta epsilon " + plant + "another way to close it"),
             (900003, "zebra " * 3), (None, None), (900004, "")]
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], DOC_SCHEMA))
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == base.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > 0.8 * base.count() and counts[3] <= counts[2] <= counts[1] <= counts[0]
    texts = spark.read.parquet(str(tmp_path / "suffix_array_dedup")).filter(F.col("text").contains("written once and then it was copied"))
    assert texts.count() == 0
    kept = spark.read.parquet(str(tmp_path / "suffix_array_dedup"))
    assert kept.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_dedup_stage_keeps_one_per_group(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, text), (3, text + " w60"), (4, "other words that stand alone here"), (5, ""), (6, None), (None, text)]
    out = corpus_pipeline.near_dedup(spark, docs_of(rows), SF).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "4", "5", "6", "None"]


def test_stages_on_odd_rows_and_empty(spark, docs_of):
    for rows in (ODD_ROWS, []):
        docs = docs_of(rows)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0


def test_passage_cut_keeps_whole_characters():
    raw = "aé日b".encode()
    assert corpus_pipeline._whole_chars(raw, 2, 4) == (3, 3)
    assert corpus_pipeline._whole_chars(raw, 1, 6) == (1, 6)
