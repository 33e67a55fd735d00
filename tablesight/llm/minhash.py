"""MinHash near-duplicates with tensored banding.

Two collections of minhash values are computed per document, each of ``per_side`` keys
made of ``HALF`` minhashes. Every pair of a key of the first and a key of the second
collection is one table key: ``per_side`` squared tables of 2 x HALF minhashes each for
the price of 2 x ``per_side`` x HALF minhashes. ``per_side`` follows from the threshold
so that a pair of documents right at it is missed with probability ``MISS`` at most.

A key that only one document has cannot make a table key that two share, so such keys
are left out before the pairs of keys are formed.

Candidates are verified on full shingle sets, without expanding a bucket into all its
pairs. First every bucket's members are compared with its smallest member; the members of
all buckets with the same smallest member are its star. Two candidates are always in one
star. Then, in stars whose members are still in different components, the members
outside the largest component are compared with all others inside tasks, in pairs of
chunks; only a forest of the links found comes out. No link is lost: a pair within one
component cannot change the components.

Equal texts are one candidate. Nulls, empties: a document without words has an empty
set and links with nothing; one with fewer words than a shingle has its whole word
sequence as one shingle. Repeated rows of one id with equal texts get equal results; an
id with several texts is one node of the graph. A null id links with nothing. An empty
table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, frames, text_key, text_or_empty
from .components import connected_components, unite

#: Minhashes in one key of a collection; a table key has twice as many.
HALF = 2
MISS = 3e-5
#: Expected sets in one chunk of a star, and expected shingles over all its sets.
CHUNK_SETS = 256
CHUNK_SHINGLES = 1 << 17
#: Pairs that a shingle stands for above which it is counted by a matrix product.
DENSE = 256
#: Words kept in a worker's memo of word -> hash.
MEMO = 50_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys_per_side(threshold: float) -> int:
    return max(1, math.ceil(math.log(MISS / 2) / math.log(1 - threshold ** HALF)))


class Shingler:
    """Sets of 64-bit shingle hashes; words are runs of anything but ASCII white space,
    with A-Z in lower case."""

    def __init__(self, size: int):
        import xxhash

        self.size = size
        self._hash = xxhash.xxh3_64_intdigest
        self._memo: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        if len(self._memo) >= MEMO:
            self._memo.clear()
        h = self._memo[w] = self._hash(w)
        return h

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = text.encode("utf-8", "replace").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        got = self._memo.get
        hashes = [got(w) for w in words]
        if None in hashes:
            hashes = [self._word(w) if h is None else h for w, h in zip(words, hashes)]
        h = np.array(hashes, dtype=np.uint64)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            out = (out ^ h[j:len(h) - n + 1 + j]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signer(per_side: int):
    """Function from a shingle set to its 2 x per_side keys (two collections)."""
    rng = np.random.default_rng(20)
    count = 2 * per_side * HALF
    mul = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)

    def sign(s: np.ndarray) -> np.ndarray:
        low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 4096):
            x = s[i:i + 4096]
            x = x ^ (x >> np.uint64(32))
            low = np.minimum(low, (x[:, None] * mul[None, :] + add[None, :]).min(axis=0))
        key = np.arange(count // HALF, dtype=np.uint64)
        for part in low.reshape(-1, HALF).T:
            key = (key ^ part) * _MIX
            key ^= key >> np.uint64(31)
        return key.view(np.int64)

    return sign


def class_id(text: Column) -> Column:
    """The node of a text in the graph: 64 bits of its MD5."""
    return F.xxhash64(text_key(text))


def signatures(docs: DataFrame, shingle: int, per_side: int) -> DataFrame:
    """(doc_id, cid, n_shingles, keys): the keys of both collections of every document."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, sign = Shingler(shingle), signer(per_side)
        for pdf in frames(it, 512):
            sets = [shingler.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "cid": pdf["cid"], "n_shingles": [len(s) for s in sets],
                                "keys": [sign(s) for s in sets]})

    src = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    src = src.withColumn("cid", class_id(F.col("text")))
    out = src.mapInPandas(run, "doc_id string, cid long, n_shingles long, keys array<long>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(cid, n, members) of (cid, text): the sorted 64-bit shingle hashes as bytes."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle)
        for pdf in frames(it):
            sets = [shingler.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"cid": pdf["cid"], "n": [len(s) for s in sets], "members": [s.tobytes() for s in sets]})

    return texts.select("cid", "text").mapInPandas(run, "cid long, n long, members binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have den * |both| >= num * |either|."""
    own = sets.select(F.col("cid").alias("__id"), "members")
    with_b = pairs.join(own, F.col("b") == F.col("__id")).select("a", "b", F.col("members").alias("set_b"))
    with_a = with_b.join(own, F.col("a") == F.col("__id")).select("a", "b", F.col("members").alias("set_a"), "set_b")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(it):
            keep = []
            for x, y in zip(pdf["set_a"], pdf["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return with_a.mapInPandas(run, "a long, b long")


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets. Shingles that many
    of both have go through a matrix product, the others through their few pairs."""
    out = np.zeros((len(left), len(right)), np.int64)
    (vl, rl), (vr, rr) = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right)]
    common = np.intersect1d(vl, vr)
    if not len(common):
        return out
    (cl, rl), (cr, rr) = [(np.searchsorted(common, v[k]), r[k]) for v, r in ((vl, rl), (vr, rr)) for k in (np.isin(v, common),)]
    dl, dr = np.bincount(cl, minlength=len(common)), np.bincount(cr, minlength=len(common))
    dense = np.nonzero(dl * dr > DENSE)[0]
    for i in range(0, len(dense), 2048):
        at = np.full(len(common), -1)
        part = dense[i:i + 2048]
        at[part] = np.arange(len(part))
        x, y = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for m, c, r in ((x, cl, rl), (y, cr, rr)):
            k = at[c] >= 0
            m[r[k], at[c[k]]] = 1
        out += (x @ y.T).astype(np.int64)
    thin = dl * dr <= DENSE
    ol, orr = np.argsort(cl, kind="stable"), np.argsort(cr, kind="stable")
    ol, orr = ol[thin[cl[ol]]], orr[thin[cr[orr]]]
    # every left occurrence against the run of right occurrences of the same shingle
    run = np.searchsorted(cr[orr], cl[ol], "left")
    n = dr[cl[ol]]
    upto = np.r_[0, np.cumsum(n)]
    i = 0
    while i < len(ol):  # about a million pairs at a time
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + 1_000_000)))
        k = n[i:j]
        first = np.repeat(run[i:j] - (upto[i:min(j, len(ol))] - upto[i]), k)
        np.add.at(out, (np.repeat(rl[ol[i:j]], k), rr[orr[first + np.arange(k.sum())]]), 1)
        i = j
    return out


def _compare(num: int, den: int):
    """The function for one (center, chunk of few, chunk of all): a forest of the links found
    across components."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        few = pdf["few"].to_numpy(bool)
        if not few.any() or few.all():
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x, y = pdf[few], pdf[~few]
        sets = [[np.frombuffer(m, np.uint64) for m in part["members"]] for part in (x, y)]
        both = _common_counts(*sets)
        nx, ny = (np.array([len(s) for s in part]) for part in sets)
        linked = (both > 0) & (den * both >= num * (nx[:, None] + ny[None, :] - both))
        linked &= x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :]
        i, j = np.nonzero(linked)
        nodes, where = np.unique(np.concatenate([x["cid"].to_numpy(np.int64), y["cid"].to_numpy(np.int64)]), return_inverse=True)
        parent = unite(np.arange(len(nodes)), where[:len(x)][i], where[len(x):][j])
        moved = np.nonzero(parent != np.arange(len(nodes)))[0]
        return pd.DataFrame({"a": nodes[moved], "b": nodes[parent[moved]]})

    return run


def links_across(stars: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members of one star that are in different components so far.

    The members outside the star's largest component are compared with all its members,
    in pairs of chunks of a bounded expected size; pairs do not leave the tasks."""
    members = stars.select(F.col("a").alias("c"), F.col("b").alias("cid"), F.col("nb").alias("n")).unionByName(
        stars.select(F.col("a").alias("c"), F.col("a").alias("cid"), F.col("na").alias("n")).distinct())
    place = comps.select(F.col("node").alias("__node"), F.col("component").alias("__comp"))
    members = cut(members.join(place, F.col("cid") == F.col("__node"), "left").select("c", "cid", "n", F.coalesce("__comp", "cid").alias("comp")))
    counts = members.groupBy("c", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    most = F.max(F.struct("m", "s", "comp"))
    mixed = counts.groupBy("c").agg(most.alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    chunks = lambda m, s: F.greatest(F.ceil(m / CHUNK_SETS), F.ceil(s / CHUNK_SHINGLES)).cast("int")
    mixed = mixed.select("c", F.col("main.comp").alias("main"), chunks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("ki"),
                         chunks(F.col("m"), F.col("s")).alias("kj"))
    rows = members.drop("n").join(mixed, "c").join(sets.select("cid", "members"), "cid")
    h = F.xxhash64("cid")
    few = rows.filter("comp <> main").select("c", F.pmod(h, F.col("ki")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("kj") - 1)).alias("j"),
                                             F.lit(True).alias("few"), "cid", "comp", "members")
    every = rows.select("c", F.explode(F.sequence(F.lit(0), F.col("ki") - 1)).alias("i"), F.pmod(h, F.col("kj")).cast("int").alias("j"),
                        F.lit(False).alias("few"), "cid", "comp", "members")
    return few.unionByName(every).groupBy("c", "i", "j").applyInPandas(_compare(num, den), "a long, b long")


def _sizes_allow(p: Column, q: Column, num: int, den: int) -> Column:
    return F.lit(den) * F.least(p, q) >= F.lit(num) * F.greatest(p, q)


def table_keys(classes: DataFrame, per_side: int) -> DataFrame:
    """(key, cid, n): the table keys of (cid, n, keys), all pairs of a first-collection and a
    second-collection key that some other document has too."""
    single = classes.select("cid", "n", F.posexplode("keys").alias("side", "x"))
    shared = single.groupBy("x").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("x")
    left = F.col("side") < per_side
    kept = single.join(shared, "x").groupBy("cid", "n").agg(
        F.collect_list(F.when(left, F.col("x"))).alias("left"), F.collect_list(F.when(~left, F.col("x"))).alias("right"))
    return kept.select("cid", "n", F.explode("left").alias("x"), "right").select(
        "cid", "n", "x", F.explode("right").alias("y")).select(F.xxhash64("x", "y").alias("key"), "cid", "n")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; documents link where
    the Jaccard similarity of their shingle sets is ``num / den`` or more."""
    per_side = keys_per_side(num / den)
    rows = cut(signatures(docs, shingle, per_side))
    some = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = cut(some.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")))
    entries = cut(table_keys(classes, per_side))
    shared = entries.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("c"), F.max("cid").alias("top")).filter(F.col("c.cid") < F.col("top"))
    buckets = cut(entries.join(shared.select("key", "c"), "key"))
    members = buckets.select(F.col("cid").alias("__cid")).distinct()
    members = members.join(classes.select("cid", "rep"), F.col("cid") == F.col("__cid")).select("__cid", "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("cid", class_id(F.col("text")))
    texts = texts.join(members, (F.col("doc_id") == F.col("rep")) & (F.col("cid") == F.col("__cid")))
    sets = cut(shingle_sets(texts, shingle).dropDuplicates(["cid"]))
    stars = cut(buckets.filter(F.col("cid") != F.col("c.cid")).select(
        F.col("c.cid").alias("a"), F.col("cid").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb")).distinct())
    links = cut(verified(stars.filter(_sizes_allow(F.col("na"), F.col("nb"), num, den)), sets, num, den))
    more = cut(links_across(stars, connected_components(links), sets, num, den))
    links = links.unionByName(more)
    # an id with several texts is one node: it ties the classes of its texts together
    several = some.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a <> z")
    ties = some.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("cid").alias("b")).filter("a <> b")
    found = connected_components(links.unionByName(ties))
    found = classes.select("cid", "rep").join(found, F.col("cid") == F.col("node"), "left").select(
        "cid", "rep", F.coalesce("component", "cid").alias("comp"))
    least = found.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = found.join(least, "comp").select("cid", "component_id")
    linked = some.join(found, "cid").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
