"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def bpe_files() -> dict[str, str]:
    """Where the public vocabulary files lie; they are parameters of the operators."""
    import public_tokenizers as files

    return {"tokenizer_json": files.path("byte_bpe_50k.json"), "ranks": files.path("byte_bpe_50k.tiktoken"), "pattern": files.PATTERN}


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), **bpe_files(), capacity=1024, end_id=2, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _scored(model, docs: DataFrame, threshold: float) -> DataFrame:
    from .common import learn_rows

    return model.score(docs.select("doc_id", "text")).select(
        "doc_id", (~learn_rows(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


@_query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality

    docs = table(spark, sf_dir, "documents")
    return _scored(fit_quality(docs, table(spark, sf_dir, "labels")), docs, 0.7)


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity

    docs = table(spark, sf_dir, "documents")
    return _scored(fit_toxicity(docs, table(spark, sf_dir, "labels")), docs, 0.3)


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import text_or_empty
    from .token_counts import count_tokens

    files = bpe_files()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, files["ranks"], files["pattern"]).select(
        "doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"))


@_query
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint, fingerprint_documents

    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"),
                        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@_query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import link_embeddings

    return link_embeddings(table(spark, sf_dir, "embeddings"), cosine=0.93)


@_query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


@_query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), min_bytes=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))  # a cut may go through a character


@_query
def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    from .nbest import segmentation_digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = segmentation_digest(docs, files.path("piece_bpe_32k.model"), n=3)
    return found.select("doc_id", "n_pieces", "ids_crc32", "round_trip", *[F.get("scores", i).alias(f"score_{i + 1}") for i in range(3)])


@_query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    from .alignment import alignment_digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment_digest(docs, **bpe_files(), model_file=files.path("piece_bpe_32k.model"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import longest_run, periodic_runs, planted_period

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, id_col="doc_id", reorder=planted_period).withColumn("best", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import find_licenses

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_licenses(docs)
    words = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("notices", lambda p: p["label"]))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
                        F.array_max(words).alias("last_word"), joined(base).alias("base_labels"), joined(every).alias("labels"),
                        "score", "notices")
