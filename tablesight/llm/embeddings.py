"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= c means squared distance <= 2 - 2c. A rotation leaves
distances as they are and spreads them evenly; the rotated vector is split into blocks,
and each block gets a budget in proportion to its dimensions. If the whole distance
keeps to the whole budget, at least one block keeps to its own. So each block is
range-joined by itself: a grid over the first coordinates of the block puts every
vector into its home cell and into the neighbour cells that it is within the radius
of, and a pair is a candidate where its block distance keeps to the budget. A pair is
counted at its first such block only, and verified there by the exact cosine of the
original vectors in double precision.

Equal vectors with equal labels are one class with a multiplicity; only classes are
compared, so copies are never expanded into pairs. A cell with many vectors is dealt
out as pairs of chunks, each chunk of a bounded expected size; tasks return counts and
a spanning forest of the links found, not the pairs.

Nulls and other odd values: vectors that are null, empty, zero or hold null or
non-finite components, and rows without a label, link with nothing. Vectors of
different length do not link. Repeated rows, and different vectors with one id, count as
vectors of their own. An empty
table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components, unite

BLOCKS = 4
GRID_DIMS = 2
#: A cell's side in radii; vectors within one radius of a border go to both sides.
SIDE = 2.0
#: Expected vectors in one chunk of a cell, and rows compared at a time in a task.
CHUNK = 8_192
ROWS = 512
#: Relative slack of the block budgets for rounding; the exact check follows.
SLACK = 1e-4


@functools.lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def budgets(dim: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (hi - lo) / dim * (1 + SLACK) + 1e-9 for lo, hi in block_bounds(dim)]


def _cells(label: int, rot: np.ndarray, cosine: float) -> list[tuple[str, bool]]:
    """(cell key, home) of every cell that one rotated vector goes to."""
    out = []
    for b, ((lo, hi), budget) in enumerate(zip(block_bounds(len(rot)), budgets(len(rot), cosine))):
        radius = budget ** 0.5 * 1.0001
        x = rot[lo:min(hi, lo + GRID_DIMS)].astype(float)
        home = np.floor(x / (SIDE * radius)).astype(int)
        near = [sorted({int(np.floor((v - radius) / (SIDE * radius))), int(h), int(np.floor((v + radius) / (SIDE * radius)))})
                for v, h in zip(x, home)]
        out += [(f"{label}/{len(rot)}/{b}/" + ",".join(map(str, c)), c == tuple(home.tolist())) for c in itertools.product(*near)]
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """The vector times the power of two that brings its largest component to 0.5 up to 1:
    cosines stay, and no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _spread(cosine: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 1024):
                out = []
                for cls, label, mult, emb in pdf.iloc[at:at + 1024][["cls", "label", "mult", "emb"]].itertuples(index=False):
                    v = _scaled(np.asarray(emb, dtype=np.float64))
                    rot = (rotation(len(v)) @ (v / np.linalg.norm(v))).astype(np.float32)
                    raw, turned = v.tobytes(), rot.tobytes()
                    out += [(cell, home, cls, mult, raw, turned) for cell, home in _cells(label, rot, cosine)]
                yield pd.DataFrame(out, columns=["cell", "home", "cls", "mult", "raw", "rot"])

    return run


def _pairs_below(a: np.ndarray, b: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose squared distance is at most about ``budget`` (by one product)."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.nonzero(d <= budget + 1e-4)


def _compare(cosine: float):
    """The function for one (cell, home chunk, other chunk): counts and a link forest."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf["left"].to_numpy(bool)
        mine, other = pdf[left], pdf[~left]
        out = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        if len(mine) == 0 or len(other) == 0:
            return out
        block = int(key[0].split("/")[2])
        unpack = lambda s, t: np.frombuffer(b"".join(s), dtype=t).reshape(len(s), -1)
        u, v = unpack(mine["raw"], np.float64), unpack(other["raw"], np.float64)
        p, q = unpack(mine["rot"], np.float32), unpack(other["rot"], np.float32)
        nu, nv = np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1))
        ids, others = mine["cls"].to_numpy(np.int64), other["cls"].to_numpy(np.int64)
        mult = other["mult"].to_numpy(np.int64)
        bounds, limit = block_bounds(u.shape[1]), budgets(u.shape[1], cosine)
        lo, hi = bounds[block]
        nodes, where = np.unique(np.concatenate([ids, others]), return_inverse=True)
        at_mine, at_other = where[:len(ids)], where[len(ids):]
        parent, links = np.arange(len(nodes)), np.zeros(len(ids), np.int64)
        for s in range(0, len(ids), ROWS):
            i, j = _pairs_below(p[s:s + ROWS, lo:hi], q[:, lo:hi], limit[block])
            i += s
            keep = ids[i] != others[j]
            i, j = i[keep], j[keep]
            for t in range(0, len(i), 200_000):
                a, b = i[t:t + 200_000], j[t:t + 200_000]
                d = (p[a].astype(np.float64) - q[b]) ** 2
                first = d[:, lo:hi].sum(1) <= limit[block]
                for k in range(block):
                    first &= d[:, bounds[k][0]:bounds[k][1]].sum(1) > limit[k]
                a, b = a[first], b[first]
                linked = (u[a] * v[b]).sum(1) / (nu[a] * nv[b]) >= cosine
                a, b = a[linked], b[linked]
                np.add.at(links, a, mult[b])
                parent = unite(parent, at_mine[a], at_other[b])
        moved = np.nonzero(parent != np.arange(len(nodes)))[0]
        forest = pd.DataFrame({"a": nodes[moved], "b": nodes[parent[moved]], "links": 0})
        some = links > 0
        counts = pd.DataFrame({"a": ids[some], "b": ids[some], "links": links[some]})
        return pd.concat([counts, forest], ignore_index=True)

    return run


def link_embeddings(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("emb"),
                          F.col("label").alias("label"))
    finite = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("emb", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("__fit", fit)
    good = rows.filter("__fit")
    classes = good.groupBy("label", "emb").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    # numbers of the classes stay as they are once the checkpoint is written
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    spread = classes.select("cls", F.col("label").cast("string").alias("label"), "mult", "emb").mapInPandas(
        _spread(cosine), "cell string, home boolean, cls long, mult long, raw binary, rot binary")
    spread = cut(spread)
    sizes = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).filter("homes > 0 and n > 1")
    chunks = sizes.select(F.col("cell").alias("__cell"), F.ceil(F.col("n") / CHUNK).cast("int").alias("__k"))
    dealt = spread.join(chunks, F.col("cell") == F.col("__cell")).withColumn("__c", F.pmod(F.xxhash64("cls"), F.col("__k")).cast("int"))
    every = F.sequence(F.lit(0), F.col("__k") - 1)
    left = dealt.filter("home").select("cell", F.col("__c").alias("i"), F.explode(every).alias("j"), F.lit(True).alias("left"), "cls", "mult", "raw", "rot")
    right = dealt.select("cell", F.explode(every).alias("i"), F.col("__c").alias("j"), F.lit(False).alias("left"), "cls", "mult", "raw", "rot")
    found = cut(left.unionByName(right).groupBy("cell", "i", "j").applyInPandas(_compare(cosine), "a long, b long, links long"))
    links = found.groupBy("a").agg(F.sum("links").alias("__links"))
    comps = connected_components(found.filter("a <> b"))
    least = (comps.join(classes.select("cls", "rep"), F.col("node") == F.col("cls")).groupBy("component").agg(F.min("rep").alias("__component")))
    comps = comps.join(least, "component").select(F.col("node").alias("__node"), "__component")
    info = classes.join(links, F.col("cls") == F.col("a"), "left").join(comps, F.col("cls") == F.col("__node"), "left").select(
        F.col("label").alias("__l"), F.col("emb").alias("__e"),
        (F.coalesce("__links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"),
        F.coalesce("__component", "rep").alias("component_id"))
    linked = good.join(info, (F.col("label") == F.col("__l")) & (F.col("emb") == F.col("__e"))).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("__fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
