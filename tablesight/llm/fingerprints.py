"""Document fingerprints: bottom-k sketches of word-shingle hashes, in SQL functions only.

A text's sketch is the sorted array of the ``k`` smallest 40-bit hashes of its distinct
shingles of five words (a shorter text is one shingle; a text without words has an
empty sketch). The ``k`` smallest hashes of a union are the ``k`` smallest of the
sketches' union, so sketches merge without the texts. From two sketches:

* resemblance: the share of the union's ``k`` smallest hashes that both hold;
* containment of A in B: resemblance x estimated union size / estimated size of A;
* distinct shingles: exact below ``k``, else (k - 1) / (k-th smallest hash as a share
  of the hash range).

Nulls, empties, ties: null text counts as empty; two empty sketches have resemblance 1,
one empty sketch 0. Equal texts have equal sketches. Rows that tie in the id are
ordered by a hash of the text; a null id comes first. An empty table gives an empty
table; extra columns pass through ``with_sketch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import BUCKET, default_buckets, with_range_bucket
from .common import text_or_empty

SHINGLE = 5
HASH_BITS = 40


def with_sketch(df: DataFrame, text_col: str, name: str, k: int = 128, shingle: int = SHINGLE) -> DataFrame:
    """Add the bottom-k sketch of a text column as ``array<bigint>``.

    Word hashes, shingle hashes and the sorted sketch are separate projections, so that
    each is computed once per row and only looked up by the next."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), "")
    keep = [F.col(c) for c in df.columns]
    hashed = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("__h"))
    h = F.col("__h")
    n = F.size(h)
    one = F.transform(F.sequence(F.lit(0), n - shingle),
                      lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]), 64 - HASH_BITS))
    short = F.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - HASH_BITS))).otherwise(
        F.array().cast("array<bigint>"))
    made = hashed.select(*keep, F.when(n >= shingle, one).otherwise(short).alias("__s"))
    return made.select(*keep, F.slice(F.sort_array(F.array_distinct("__s")), 1, k).alias(name))


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: 10 hex digits per hash."""
    return F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    kth = (F.element_at(sketch, -1) + 1) / F.lit(float(1 << HASH_BITS))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of A's shingles that B holds; 1 for an empty A."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    share = resemblance(a, b, k) * distinct_shingles(union, k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merge_sketches(df: DataFrame, group: list[str], sketch: str, k: int = 128) -> DataFrame:
    """One sketch per group: the sketch of the group's texts together. Each task keeps
    its ``k`` smallest hashes of a group before the shuffle."""
    values = df.select(*group, F.explode(sketch).alias("__v")).distinct()
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__v"))
    low = values.withColumn("__r", rank).filter(F.col("__r") <= k)
    merged = low.groupBy(*group).agg(F.sort_array(F.collect_list("__v")).alias(sketch))
    empty = df.select(*group).distinct()
    same = [empty[c].eqNullSafe(merged[c]) for c in group]
    return empty.join(merged, same, "left").select(
        *[empty[c] for c in group], F.coalesce(merged[sketch], F.array().cast("array<bigint>")).alias(sketch))


def with_next(docs: DataFrame, buckets: int) -> tuple[DataFrame, Window]:
    """(doc_id, text, next_text): each document beside the next one by id, the last beside
    the first.

    Ids are cut into ranges and each range is one window partition. A range also gets the
    first document of the following range as its last row, so no text is joined."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("__tie", F.xxhash64("text"))
    rows = with_range_bucket(rows, ["doc_id"], buckets)
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("__tie").alias("c"))
    first = rows.groupBy(BUCKET).agg(F.min_by("text", order).alias("text"))
    ends = Window.orderBy(BUCKET)  # one row per range
    last_bucket = F.max(BUCKET).over(Window.partitionBy())
    guard = first.select(F.coalesce(F.lag(BUCKET).over(ends), last_bucket).alias(BUCKET), "text",
                         F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                         F.lit(0).cast("long").alias("__tie"), F.lit(1).alias("__guard"))
    every = rows.withColumn("__guard", F.lit(0)).unionByName(guard)
    w = Window.partitionBy(BUCKET).orderBy("__guard", F.col("doc_id").asc_nulls_first(), "__tie")
    return every.withColumn("next_text", F.lead("text").over(w)), w


def fingerprint_documents(docs: DataFrame, k: int = 128, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited form (the last quarter replaced by the
    beginning of the next document) and their likeness to each other and to the next one."""
    found, w = with_next(docs, buckets or 4 * default_buckets(docs))
    m = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - m), F.substring("next_text", F.lit(1), m))
    out = found.withColumn("edited", F.coalesce(edited, F.lit("")))
    # a column under which neither text has to travel further
    out = with_sketch(out, "text", "__own", k)
    out = out.withColumn("__next", F.lead("__own").over(w)).filter(F.col("__guard") == 0)
    out = out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "__own", "__next", "edited")
    out = with_sketch(out, "edited", "__edited", k)
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      F.col("__own").alias("sketch"), F.col("__edited").alias("edited_sketch"),
                      resemblance(F.col("__own"), F.col("__edited"), k).alias("near_edited"),
                      resemblance(F.col("__own"), F.col("__next"), k).alias("near_next"))
