"""Many k-means fits in one job a round, and the plain Euclidean silhouette with bounds.

``fit_many`` advances all numbers of clusters and all starts together: a round is one
pass that gives every model's sums per centre, one grouped aggregate, and a few hundred
rows on the driver. The starting centres are drawn as k-means++ does it, and the first k
centres of a start serve every k.

``plain_silhouettes`` bounds the mean silhouette on plain distances without point pairs.
Space is cut into cells (a hierarchy of halvings); a cell holds the number, mean c and
mean squared deviation v of its points of a cluster. For any point x the mean distance to
those points lies between |x - c| and sqrt(|x - c|^2 + v) (Jensen, both ways), so sums
over a set of cells that covers a cluster bound the mean distance to it, and with it a(x),
b(x) and s(x). Points of one neighbourhood share the set: coarse cells where they are well
separated from it, fine ones near it. Cells are refined until the caller's question (a
quality band, the best k) is decided by the bounds or the finest cells are used; then the
bounds say what is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

MAX_ROUNDS = 100
#: A model rests when no centre moves farther than this (features are standardised).
TOLERANCE = 1e-4
#: Halvings of space and how well separated cells have to be, from coarse to fine.
REFINEMENTS = ((6, 0.4), (9, 0.2), (12, 0.1), (14, 0.05))
#: Halvings of one dimension at quantiles; more are even.
KNOTS = 7
#: Halvings between two levels of the hierarchy, and those of the neighbourhoods of points.
LEVEL, NEAR = 2, 6
#: Numbers (centres or cells, times dimensions) that may go to the tasks.
MOST_VALUES = 20_000_000
_SLACK = 1e-9
#: Points whose distances to all centres are held at a time.
BLOCK = 4_096


def _points(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    return np.array(pdf[vec].tolist(), np.float64).reshape(len(pdf), -1)


def _as_array(vec: str) -> Column:
    return F.transform(col(vec), lambda x: x.cast("double"))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per row from its hash: the same wherever the row is."""
    x = h.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 + 2.0 ** -54


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2.0 * (x @ centres.T) + (centres * centres).sum(1))


def starting_centres(data: DataFrame, key: str, vec: str, most: int, starts: int, seed: int) -> list[np.ndarray]:
    """``starts`` sequences of ``most`` centres: each next one is a row drawn in proportion to
    its squared distance from those before it (an exponential race between the rows)."""
    rows = data.select(F.xxhash64(col(key), col(vec)).alias("h"), _as_array(vec).alias("v"))
    chosen: list[list[np.ndarray]] = [[] for _ in range(starts)]
    for step in range(most):
        before = [np.array(c) for c in chosen]

        def race(it: Iterator[pd.DataFrame], step=step, before=before) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[float, list[float]]] = {}
            for pdf in it:
                if not len(pdf):
                    continue
                x, h = _points(pdf, "v"), pdf["h"].to_numpy(np.int64)
                for s in range(starts):
                    weight = _squares(x, before[s]).min(1) if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        time = -np.log(_uniform(h, (seed * 1_000 + s) * 1_000 + step)) / weight
                    i = int(time.argmin())
                    if np.isfinite(time[i]) and time[i] < best.get(s, (np.inf,))[0]:
                        best[s] = float(time[i]), x[i].tolist()
            if best:
                yield pd.DataFrame([(s, t, v) for s, (t, v) in best.items()], columns=["s", "t", "v"])

        found = rows.mapInPandas(race, "s int, t double, v array<double>").groupBy("s").agg(F.min_by("v", F.struct("t", "v")).alias("v"))
        drawn = {r["s"]: np.array(r["v"]) for r in found.collect()}
        for s in range(starts):
            if s in drawn:
                chosen[s].append(drawn[s])
            elif chosen[s]:
                chosen[s].append(chosen[s][-1])  # fewer distinct points than centres
    return [np.array(c) for c in chosen]


def fit_many(data: DataFrame, key: str, vec: str, ks: Sequence[int], starts: int = 10, seed: int = 42,
             max_rounds: int = MAX_ROUNDS) -> dict[int, tuple[np.ndarray, float]]:
    """The best of ``starts`` k-means fits of every k: (centres, sum of squared distances).
    ``data`` is read once a round, so it should be persisted."""
    first = starting_centres(data, key, vec, max(ks), starts, seed)
    if not len(first[0]):
        return {}
    centres = {(k, s): first[s][:k] for k in ks for s in range(starts)}
    if sum(c.size for c in centres.values()) > MOST_VALUES:
        raise ValueError("too many centre values to ship to the tasks")
    moving = list(centres)
    for _ in range(max_rounds):
        sums = _sums(data, vec, [centres[m] for m in moving])
        still = []
        for i, m in enumerate(moving):
            new = centres[m].copy()
            for c, (n, total, _) in sums.get(i, {}).items():
                new[c] = total / n  # a centre without points stays
            if np.sqrt(((new - centres[m]) ** 2).sum(1).max()) > TOLERANCE:
                still.append(m)
            centres[m] = new
        moving = still
        if not moving:
            break
    every = list(centres)
    cost = {m: sum(x for _, _, x in found.values()) for m, found in
            ((every[i], found) for i, found in _sums(data, vec, [centres[m] for m in every]).items())}
    best = {k: min(range(starts), key=lambda s: (cost[k, s], s)) for k in ks}
    return {k: (centres[k, s], float(cost[k, s])) for k, s in best.items()}


def _sums(data: DataFrame, vec: str, models: list[np.ndarray]) -> dict[int, dict[int, tuple[int, np.ndarray, float]]]:
    """Per model and centre: points nearest to it, their sum, their squared distances."""
    together = np.concatenate(models)
    edge = np.cumsum([0, *map(len, models)])
    norm = (together * together).sum(1)[:, None]

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost, total = np.zeros(len(together)), np.zeros(len(together)), np.zeros(together.shape)
        for pdf in it:
            points = _points(pdf, "v") if len(pdf) else np.zeros((0, together.shape[1]))
            # a row per centre, and few points at a time
            for x in np.array_split(points, -(-len(points) // BLOCK) or 1):
                columns = np.ascontiguousarray(x.T)
                square = -2.0 * together @ columns
                square += norm
                square += (x * x).sum(1)
                np.maximum(square, 0.0, out=square)
                nearer = np.empty(len(x), bool)
                for lo, hi in zip(edge[:-1], edge[1:]):
                    near, least = np.zeros(len(x), np.int64), square[lo]
                    for c in range(lo + 1, hi):  # of equals the first
                        np.less(square[c], least, out=nearer)
                        np.copyto(near, c - lo, where=nearer)
                        np.minimum(square[c], least, out=least)
                    n[lo:hi] += np.bincount(near, minlength=hi - lo)
                    cost[lo:hi] += np.bincount(near, least, hi - lo)
                    for j, values in enumerate(columns):
                        total[lo:hi, j] += np.bincount(near, values, hi - lo)
        some = np.nonzero(n)[0]
        if not len(some):
            return
        yield pd.DataFrame({"c": some, "n": n[some].astype(np.int64), "total": list(total[some]), "cost": cost[some]})

    rows = data.select(_as_array(vec).alias("v")).mapInPandas(assign, "c int, n long, total array<double>, cost double")
    out: dict[int, dict[int, tuple[int, np.ndarray, float]]] = {}
    for r in rows.groupBy("c").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
                                   F.sum("cost").alias("cost")).collect():  # one row per centre
        m = int(np.searchsorted(edge, r["c"], side="right")) - 1
        out.setdefault(m, {})[r["c"] - int(edge[m])] = r["n"], np.array(r["total"]), r["cost"]
    return out


class Bounds(NamedTuple):
    low: float
    high: float

    @property
    def middle(self) -> float:
        return (self.low + self.high) / 2


class _Space:
    """A hierarchy of halvings: each bit of a cell's code halves one dimension at a quantile."""

    def __init__(self, data: DataFrame, vec: str, bits: int):
        row = data.agg(Summarizer.mean(array_to_vector(_as_array(vec))).alias("m"),
                       Summarizer.variance(array_to_vector(_as_array(vec))).alias("v")).first()
        self.mean, spread = np.array(row["m"]), np.array(row["v"])
        self.order, of = [], np.zeros(len(spread), np.int64)
        for _ in range(bits):
            j = int((spread / 4.0 ** of).argmax())
            self.order.append(j)
            of[j] += 1
        self.depth = of
        x = _as_array(vec)
        knots = {j: 1 << min(int(of[j]), KNOTS) for j in range(len(of)) if of[j]}
        row = data.agg(*[F.percentile_approx(x[j], [i / m for i in range(m + 1)], 8 * m).alias(f"c{j}") for j, m in knots.items()]).first()
        # deeper halvings cut evenly between two quantiles
        self.cuts = {j: np.interp(np.arange(1, 1 << int(of[j])) * m / (1 << int(of[j])), np.arange(m + 1), np.array(row[f"c{j}"]))
                     for j, m in knots.items()}

    def codes(self, x: np.ndarray) -> np.ndarray:
        place = {j: np.searchsorted(c, x[:, j], side="right") for j, c in self.cuts.items()}
        left = self.depth.copy()
        code = np.zeros(len(x), np.int64)
        for j in self.order:
            left[j] -= 1
            code = code << 1 | (place[j] >> left[j] & 1)
        return code


class _Level(NamedTuple):
    cluster: np.ndarray
    code: np.ndarray
    n: np.ndarray
    centre: np.ndarray
    variance: np.ndarray
    child: np.ndarray  # first child in the next level, and one past the last


def _levels(cluster: np.ndarray, code: np.ndarray, n: np.ndarray, total: np.ndarray, square: np.ndarray, bits: int) -> list[_Level]:
    """Cells of one labelling from coarse to fine."""
    out: list[_Level] = []
    for b in [*range(0, bits, LEVEL), bits]:
        key = np.stack([cluster, code >> (bits - b)])
        order = np.lexsort((key[1], key[0]))
        new = np.nonzero(np.r_[True, (np.diff(key[:, order], axis=1) != 0).any(0)])[0]
        m = np.add.reduceat(n[order], new)
        centre = np.add.reduceat(total[order], new) / m[:, None]
        variance = np.maximum(0.0, np.add.reduceat(square[order], new) / m - (centre * centre).sum(1))
        out.append(_Level(key[0][order][new], key[1][order][new], m, centre, variance, np.zeros(0, np.int64)))
    for i, (up, down) in enumerate(zip(out, out[1:])):
        step = down.code >> (min(bits, (i + 1) * LEVEL) - i * LEVEL)
        first = np.nonzero(np.r_[True, (np.diff(down.cluster) != 0) | (np.diff(step) != 0)])[0]
        out[i] = up._replace(child=np.r_[first, len(down.n)])
    return out


def _cover(levels: list[_Level], centre: np.ndarray, spread: float, apart: float) -> tuple[np.ndarray, ...]:
    """Cells that cover all points once, as seen from a neighbourhood: (cluster, n, centre, variance)."""
    taken, at = [], np.arange(len(levels[0].n))
    for i, level in enumerate(levels):
        far = np.sqrt(((level.centre[at] - centre) ** 2).sum(1)) - 2.0 * spread
        ok = np.sqrt(level.variance[at]) <= apart * np.maximum(far, 0.0)
        ok |= (level.n[at] == 1) | (i == len(levels) - 1)
        here = at[ok]
        taken.append((level.cluster[here], level.n[here], level.centre[here], level.variance[here]))
        open_ = at[~ok]
        at = np.concatenate([np.arange(level.child[j], level.child[j + 1]) for j in open_]) if len(open_) else open_
    return tuple(np.concatenate(x) for x in zip(*taken))


def _labels(x: np.ndarray, pdf: pd.DataFrame, i: int, labelling) -> np.ndarray:
    return pdf[f"l{i}"].to_numpy(np.int64) if isinstance(labelling, str) else _squares(x, labelling).argmin(1)


def silhouette_bounds(data: DataFrame, vec: str, labellings: Sequence[str | np.ndarray], bits: int, apart: float) -> list[Bounds]:
    """Bounds of the mean plain-distance silhouette of each labelling: the name of a column of
    cluster numbers (0 and up), or an array of centres (the nearest one is a point's cluster).
    0 for points alone in their cluster, and for a single cluster."""
    space = _Space(data, vec, bits)
    names = [x for x in labellings if isinstance(x, str)]
    rows = data.select(_as_array(vec).alias("v"), *[col(x).cast("long").alias(f"l{i}") for i, x in enumerate(labellings) if isinstance(x, str)])

    def cells(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            x = _points(pdf, "v") - space.mean
            code = space.codes(x + space.mean)
            for i, labelling in enumerate(labellings):
                key, of = np.unique(np.stack([_labels(x + space.mean, pdf, i, labelling), code]), axis=1, return_inverse=True)
                total = np.zeros((key.shape[1], x.shape[1]))
                np.add.at(total, of.ravel(), x)
                yield pd.DataFrame({"i": i, "cluster": key[0], "code": key[1], "n": np.bincount(of.ravel()).astype(np.int64),
                                    "total": list(total), "square": np.bincount(of.ravel(), (x * x).sum(1))})

    found = rows.mapInPandas(cells, "i int, cluster long, code long, n long, total array<double>, square double").groupBy("i", "cluster", "code").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.sum("square").alias("square"))
    # at most 2^bits cells of every cluster come to the driver
    table = found.toPandas()
    if len(table) * max(1, len(space.mean)) > MOST_VALUES:
        raise ValueError("too many cells to ship to the tasks")
    trees, clusters = [], []
    for i in range(len(labellings)):
        part = table[table["i"] == i]
        ids, dense = np.unique(part["cluster"].to_numpy(np.int64), return_inverse=True)
        clusters.append(ids)
        trees.append(_levels(dense, part["code"].to_numpy(np.int64), part["n"].to_numpy(np.float64),
                             np.array(part["total"].tolist()).reshape(len(part), -1), part["square"].to_numpy(np.float64), bits) if len(part) else [])
    near = max(0, bits - NEAR)

    def bound(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        covers: dict[tuple[int, int], tuple] = {}
        out = np.zeros((len(labellings), 3))
        for pdf in it:
            if not len(pdf):
                continue
            raw = _points(pdf, "v")
            x, code = raw - space.mean, space.codes(raw) >> near
            label = [np.searchsorted(clusters[i], _labels(raw, pdf, i, labelling)) for i, labelling in enumerate(labellings)]
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(code[order]))[0] + 1):
                for i, tree in enumerate(trees):
                    at = int(code[part[0]])
                    if (i, at) not in covers:
                        leaf = tree[-1]
                        here = leaf.code >> near == at
                        n = leaf.n[here]
                        middle = (leaf.centre[here] * n[:, None]).sum(0) / n.sum()
                        spread = (n * (leaf.variance[here] + ((leaf.centre[here] - middle) ** 2).sum(1))).sum() / n.sum()
                        covers[i, at] = _cover(tree, middle, float(np.sqrt(spread)), apart)
                    cluster, n, centre, variance = covers[i, at]
                    size = np.bincount(cluster, n, len(clusters[i]))
                    weight = np.zeros((len(n), len(size)))
                    weight[np.arange(len(n)), cluster] = n
                    for some in np.array_split(part, max(1, len(part) * len(n) // 4_000_000)):
                        square = _squares(x[some], centre)
                        s = _mean_bounds(np.sqrt(square) @ weight, np.sqrt(square + variance) @ weight, size, label[i][some])
                        out[i] += len(some), s[0], s[1]
        yield pd.DataFrame({"i": range(len(labellings)), "n": out[:, 0], "low": out[:, 1], "high": out[:, 2]})

    sums = {r["i"]: r for r in rows.mapInPandas(bound, "i int, n double, low double, high double").groupBy("i").agg(
        *[F.sum(c).alias(c) for c in ("n", "low", "high")]).collect()}
    out = []
    for i in range(len(labellings)):
        r = sums.get(i)
        single = r is None or not r["n"] or len(clusters[i]) < 2
        out.append(Bounds(0.0, 0.0) if single else Bounds(r["low"] / r["n"] - _SLACK, r["high"] / r["n"] + _SLACK))
    return out


def _mean_bounds(low: np.ndarray, high: np.ndarray, size: np.ndarray, own: np.ndarray) -> tuple[float, float]:
    """Sums of the bounds of s(x) from the bounds of the summed distances to every cluster."""
    if len(size) < 2:
        return 0.0, 0.0
    at = np.arange(len(own))
    alone = size[own] <= 1
    a_low, a_high = (m[at, own] / np.maximum(1.0, size[own] - 1.0) for m in (low, high))
    low, high = low / size, high / size
    low[at, own] = high[at, own] = np.inf
    b_low, b_high = low.min(1), high.min(1)

    def s(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.maximum(a, b)
        return np.where(alone | (most <= 0), 0.0, (b - a) / np.where(most > 0, most, 1.0))

    return float(s(a_high, b_low).sum()), float(s(a_low, b_high).sum())


def plain_silhouettes(data: DataFrame, vec: str, labellings: Sequence[str | np.ndarray],
                      decided: Callable[[list[Bounds]], bool], refinements=REFINEMENTS) -> tuple[list[Bounds], bool]:
    """Bounds of each labelling's silhouette, refined until ``decided``; and whether they are."""
    best: list[Bounds] = [Bounds(-1.0, 1.0)] * len(labellings)
    for bits, apart in refinements:
        found = silhouette_bounds(data, vec, labellings, bits, apart)
        best = [Bounds(max(b.low, f.low), min(b.high, f.high)) for b, f in zip(best, found)]
        # bounds that meet say the value: equal labellings cannot be told apart further
        if decided(best) or all(b.high - b.low <= 1e-6 for b in best):
            return best, True
    return best, False
