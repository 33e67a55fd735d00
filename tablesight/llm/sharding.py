"""K-d tree sharding with distributed weighted medians.

Equal texts form one item, so copies are never split over shards. An item has a weight
(the bytes of all its copies) and metadata dimensions. Starting from one node, every
node is split along its widest dimension (weighted range as a share of the whole
table's range) at the weighted median, until the wanted number of leaves is reached -
2^depth leaves of near equal bytes.

The median of all nodes of a level is found together: items are counted into a fixed
number of bins of the split key per node, and the bin that holds the median is cut
into bins again, until the weight in it is a small part of the node's weight. Only
those bin sums are shuffled, and one row per node comes to the driver. The split key
is the dimension's value followed by bits of the text's hash, so ties in a dimension
never block a cut.

Nulls, ties, empties: a null text has size 1 and forms one item; null metadata counts
as 0. Repeated rows are rows like others and get slots of their own. An empty table
gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_key

#: Bins per node in one pass of the median search.
BINS = 4096
#: A median bin that holds at most this share of its node's weight is cut at its border.
TOLERANCE = 0.0005
_HASH_BITS, _DIM_BITS = 30, 31


def _items(rows: DataFrame, dims: dict[str, Column]) -> DataFrame:
    return rows.groupBy("__key").agg(
        F.sum("size").alias("__w"), *[F.min(e.cast("double")).alias(f"__d_{n}") for n, e in dims.items()])


def kd_leaves(items: DataFrame, dims: list[str], leaves: int, key: str = "__key") -> DataFrame:
    """Add ``leaf`` (0 to ``leaves`` - 1) to items with weight ``__w`` and dimensions ``__d_*``.
    ``leaves`` is rounded up to a power of two."""
    depth = max(0, math.ceil(math.log2(leaves)))
    stats = [f(F.col(f"__d_{d}")).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    whole = items.agg(*stats).first()
    unit = 1 << _DIM_BITS
    cols = []
    for d in dims:
        lo, hi = whole[f"lo_{d}"] or 0.0, whole[f"hi_{d}"] or 0.0
        scaled = (F.coalesce(F.col(f"__d_{d}"), F.lit(lo)) - F.lit(lo)) / F.lit((hi - lo) or 1.0)
        cols.append(F.least(F.floor(scaled * unit), F.lit(unit - 1)).cast("long").alias(f"__x_{d}"))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - _HASH_BITS)
    nodes = items.select(key, "__w", *cols, hashed.alias("__h"), F.lit(0).alias("leaf"))
    for _ in range(depth):
        nodes = _split_level(cut(nodes), dims)
    return nodes.select(key, "leaf")


def _split_level(nodes: DataFrame, dims: list[str]) -> DataFrame:
    """Split every node in two at its weighted median along its widest dimension."""
    spread = nodes.groupBy("leaf").agg(
        F.sum("__w").alias("w"),
        *[(F.max(f"__x_{d}") - F.min(f"__x_{d}")).alias(d) for d in dims]).collect()  # one row per node
    widest = {r["leaf"]: max(dims, key=lambda d: (r[d], -dims.index(d))) for r in spread}
    total = {r["leaf"]: r["w"] for r in spread}
    pick = F.lit(0).cast("long")
    for d in dims:
        pick = F.when(F.col("leaf").isin([n for n, x in widest.items() if x == d] or [-1]), F.col(f"__x_{d}")).otherwise(pick)
    keyed = nodes.withColumn("__k", pick * F.lit(1 << _HASH_BITS) + F.col("__h"))
    top = 1 << (_DIM_BITS + _HASH_BITS)
    span = {n: (0, top, 0.0) for n in total}  # key range that holds the median, weight below it
    at: dict[int, int] = {}
    while open_ := [n for n in span if n not in at]:
        lo, width = F.lit(0).cast("long"), F.lit(1).cast("long")
        keep = F.lit(False)
        for n in open_:
            a, b, _ = span[n]
            here = F.col("leaf") == n
            lo = F.when(here, F.lit(a)).otherwise(lo)
            width = F.when(here, F.lit(max(1, -(-(b - a) // BINS)))).otherwise(width)
            keep = keep | (here & (F.col("__k") >= a) & (F.col("__k") < b))
        bins = (keyed.filter(keep).withColumns({"__lo": lo, "__wd": width}).withColumn("__b", F.expr("(__k - __lo) div __wd"))
                .groupBy("leaf", "__b").agg(F.sum("__w").alias("w")))
        base = F.lit(0.0)
        half = F.lit(0.0)
        for n in open_:
            base = F.when(F.col("leaf") == n, F.lit(float(span[n][2]))).otherwise(base)
            half = F.when(F.col("leaf") == n, F.lit(total[n] / 2)).otherwise(half)
        run = Window.partitionBy("leaf").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        upto = bins.withColumn("upto", F.sum("w").over(run) + base).filter(F.col("upto") >= half)
        first = upto.groupBy("leaf").agg(F.min(F.struct("__b", "w", "upto")).alias("m")).collect()  # one row per node
        found = {r["leaf"]: r["m"] for r in first}
        for n in open_:
            a, b, _ = span[n]
            width_n = max(1, -(-(b - a) // BINS))
            m = found[n]
            left, below = a + m["__b"] * width_n, m["upto"] - m["w"]
            if width_n == 1 or m["w"] <= TOLERANCE * total[n]:
                # the cut goes to the border of the median bin that is nearer to the half
                at[n] = left + width_n if m["upto"] - total[n] / 2 <= total[n] / 2 - below else left
            else:
                span[n] = (left, min(b, left + width_n), below)
    cut_at = F.lit(0).cast("long")
    for n, c in at.items():
        cut_at = F.when(F.col("leaf") == n, F.lit(c)).otherwise(cut_at)
    right = (F.col("__k") >= cut_at).cast("int")
    return keyed.withColumn("leaf", F.col("leaf") * 2 + right).drop("__k")


def gapless_slots(rows: DataFrame, group: str, spread: Column, order: list[Column], buckets: int) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... within each value of ``group``. Rows are numbered per
    (group, bucket) and the counts of the group's earlier buckets are added, so no task
    sorts a whole group."""
    b = rows.withColumn("__bucket", F.pmod(spread, F.lit(buckets)))
    counts = b.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select(F.col(group).alias("__g"), F.col("__bucket").alias("__gb"),
                        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    here = Window.partitionBy(group, "__bucket").orderBy(*order)
    numbered = b.withColumn("__rn", F.row_number().over(here))
    return (numbered.join(off, (numbered[group] == off["__g"]) & (numbered["__bucket"] == off["__gb"]))
            .withColumn("slot", (F.col("__off") + F.col("__rn") - 1).cast("long"))
            .drop("__bucket", "__rn", "__g", "__gb", "__off"))


def shard_documents(docs: DataFrame, shards: int = 8, slots_per_bucket: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards near equal in bytes, equal texts together.

    Dimensions: position of the id, length of the text (log), language and source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("")).otherwise(text_key(text)).alias("__key"),
        (F.crc32(F.coalesce(F.col("lang"), F.lit("")).cast("binary"))).alias("__lang"),
        (F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary"))).alias("__source"))
        .withColumn("__uid", F.monotonically_increasing_id()))
    n = rows.count()
    dims = {"id": F.col("doc_id"), "len": F.log2(F.col("size")), "lang": F.col("__lang"), "source": F.col("__source")}
    if n:
        leaf = kd_leaves(_items(rows, dims), list(dims), shards)
        rows = rows.join(leaf, "__key").withColumnRenamed("leaf", "shard")
    else:
        rows = rows.withColumn("shard", F.lit(0))
    return gapless_slots(rows.withColumn("shard", F.col("shard").cast("int")), "shard", F.xxhash64("__uid"),
                         [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("__uid")],
                         max(8, -(-n // (shards * slots_per_bucket)))).select(
        "doc_id", "size", "text_crc32", "shard", "slot")
