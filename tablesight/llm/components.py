"""Connected components of a link table by repeated contraction.

Every round each node moves to the neighbour (or itself) that comes first in a
pseudo-random order, then links are redrawn between the places moved to. The random
order makes a constant share of the nodes move in expectation, whatever the shape, so
the rounds grow with the logarithm of the input. Links, moves and results stay in
Spark tables; only counts reach the driver. A hub with very many links is summed
before the shuffle where it is grouped, and split by adaptive execution where joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has a link, with its component's smallest node."""
    cur = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    cur = cut(cur.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        to = first.select(F.col("a").alias("node"), F.when(F.col("m") < own, F.col("m.n")).otherwise(F.col("a")).alias("to"))
        to = cut(to)
        step = to.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
        to = cut(to.join(step, F.col("to") == F.col("__n")).select("node", F.col("__t").alias("to")))
        moves.append(to)
        left = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = cur.join(left, "a").join(right, "b").filter("ta <> tb")
        cur = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not moves:
        return links.sparkSession.createDataFrame([], "node long, component long")
    place = moves[0]
    for m in moves[1:]:
        nxt = m.select(F.col("node").alias("__n"), F.col("to").alias("__t"))
        place = place.join(nxt, F.col("to") == F.col("__n"), "left").select("node", F.coalesce("__t", "to").alias("to"))
    place = cut(place)
    least = place.groupBy("to").agg(F.min("node").alias("component"))
    return cut(place.join(least, "to").select("node", "component"))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of index pairs within a task: ``parent`` (every entry a root) with the sets
    of ``a`` and ``b`` joined; the smaller index is the root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent
