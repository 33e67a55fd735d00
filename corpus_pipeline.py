"""Corpus pipeline over the documents table: toxicity filter, quality filter, MinHash
near-dedup, repeated-passage removal, best-fit packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next stage's
documents. All but the last return the columns of ``documents``. ``run`` applies them to
``documents``. No stage samples or caps its rows; the two classifiers learn from a
bounded sample of labelled rows (see their ``bound`` parameter).

Nulls and empties follow the operators: a null text counts as empty. A document without
a score cannot occur. In the dedup stage, documents without words and documents without
an id are all kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesight.llm.common import checkpoint_dir, small_batches, table, text_or_empty
from tablesight.llm.minhash import class_id, near_duplicates
from tablesight.llm.packing import pack_documents
from tablesight.llm.quality import fit_quality
from tablesight.llm.queries import bpe_files
from tablesight.llm.suffix_dedup import merge_spans, repeated_spans
from tablesight.llm.toxicity import fit_toxicity

#: A document goes if its toxicity score is this or more ...
TOXIC_FROM = 0.3
#: ... or its quality score is below this.
QUALITY_FROM = 0.5
#: Bytes of a repeated passage; over fifty words of prose are practically always longer.
PASSAGE_BYTES = 220

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.column(text_or_empty()) < TOXIC_FROM)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.filter(model.column(text_or_empty()) >= QUALITY_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.
    Of repeated rows with that id, one per text class stays."""
    small_batches(spark)
    found = near_duplicates(docs, shingle=5, num=80, den=100)
    gone = found.filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    # repeated rows: one of those that agree in id and text
    single = left.filter(F.col("doc_id").isNotNull() & (F.trim(text_or_empty()) != ""))
    rest = left.filter(F.col("doc_id").isNull() | (F.trim(text_or_empty()) == ""))
    again = single.groupBy("doc_id", class_id(text_or_empty()).alias("__c")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    if again.isEmpty():
        return left
    return single.dropDuplicates(["doc_id", "text"]).unionByName(rest).select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that occur more than once (every occurrence). A character goes if all
    its bytes do. Documents of which nothing is left go."""
    small_batches(spark)
    spans = repeated_spans(docs, PASSAGE_BYTES).select(F.col("tk").alias("__tk"), F.col("spans").alias("__spans"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            out = []
            for text, spans in zip(texts, found):
                if spans is not None and text is not None:
                    raw = text.encode("utf-8", "replace")
                    edges = [0, *(x for s, e in merge_spans(spans) for x in _whole_chars(raw, s, e)), len(raw)]
                    text = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])).decode("utf-8", "replace")
                out.append(text)
            yield pd.Series(out, dtype=object)

    cut_text = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col("text"), F.col("__spans"))
    joined = docs.withColumn("__key", F.xxhash64(text_or_empty())).join(spans, F.col("__key") == F.col("__tk"), "left")
    same, changed = joined.filter(F.col("__spans").isNull()), joined.filter(F.col("__spans").isNotNull())
    changed = changed.withColumn("text", cut_text).filter(F.trim("text") != "").withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.select(*docs.columns).unionByName(changed.select(*docs.columns))


def _whole_chars(raw: bytes, s: int, e: int) -> tuple[int, int]:
    """The span without the bytes of characters that lie in it only in part."""
    while s < e and raw[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
        e -= 1
    return s, e


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, **bpe_files(), capacity=1024, end_id=2, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("best_fit_packing", packing),
]

#: Classifiers, signatures and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared
    checkpoint folder and read again."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
