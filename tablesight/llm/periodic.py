"""Detection of periodic runs of words, and removal of their repeated periods.

Words are what lies between the bytes 0x20 and 0x09 to 0x0D. A run is a stretch of words
with smallest period q (words q apart are equal) that is at least ``least_times`` periods
and ``least_words`` words long and that no neighbouring word extends.

Periods up to ``SHORT`` are found by scanning the text against itself at that lag. Longer
ones come in scales: for periods in (k/2, k] the grams of k words are hashed (each scale's
hashes from two of the scale before) and the smallest hash of every k/2 neighbouring grams
is marked, the leftmost on ties. Inside a run of such a period q the windows q apart
have equal contents, so their marks are q apart; and as a gram of q or more words recurs
in the run at multiples of q only, the two are neighbours among the marks with that hash.
Neighbouring equal marks k/2 to k apart are therefore seeds that no run of four periods or more lacks;
each is extended to both sides by comparing words, so a seed by chance gives no run.

Texts of a batch are searched together, one after another with a separator that equals
no word; longer scales keep only the texts that are long enough for them.

Nulls, empties: a null text counts as empty, has no runs and an empty collapsed text.
Texts of any length are handled whole. Runs of different periods may overlap; a word goes
if any run has it behind its first period. Runs are ordered by start, then period.
Repeated rows get equal results; an empty table gives an empty table. Extra columns pass
through, but a table with columns named ``runs`` or ``collapsed`` is refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, refuse_clash, text_or_empty

#: Periods up to this are found by direct comparison; a power of two.
SHORT = 8
#: Bytes of text searched together (at least one text).
BLOCK = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: From a document's id as text and its number of words: which word to read at each place, or None.
Reorder = Callable[[str | None, int], np.ndarray | None]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def _marks(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of every ``width`` neighbouring ones, the leftmost on ties."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(len(h).bit_length())
    low, size = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[:len(h) - width + 1], low[width - size:])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return place[np.r_[True, place[1:] != place[:-1]]]


def _seeds(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags of neighbouring equal marks k/2 to k apart; ``h`` are hashes of k-grams."""
    mark = _marks(h, k // 2)
    order = np.argsort(h[mark], kind="stable")
    place = mark[order]
    lag = np.diff(place)
    hit = np.nonzero((h[place[1:]] == h[place[:-1]]) & (lag > k // 2) & (lag <= k))[0]
    return place[hit], lag[hit]


def _reach(differ: Callable[[int, int], np.ndarray], most: int) -> int:
    """How many of the first ``most`` places agree."""
    done, step = 0, 64
    while done < most:
        wrong = differ(done, min(done + step, most))
        at = int(wrong.argmax())
        if wrong[at]:
            return done + at
        done, step = done + len(wrong), step * 2
    return most


def _smallest(x: np.ndarray, start: int, q: int) -> bool:
    """True if the stretch of period q from ``start`` has no smaller period, which would divide q."""
    rest, f = q, 2
    while rest > 1:
        if rest % f == 0:
            d = q // f
            if np.array_equal(x[start:start + 2 * q - d], x[start + d:start + 2 * q]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
        if f * f > rest > 1:
            f = rest
    return True


def find_runs(x: np.ndarray, size: np.ndarray, least_words: int = 6, least_times: int = 4) -> np.ndarray:
    """Runs in texts of ``size`` words each that lie in ``x`` one after another, each
    followed by a number that occurs nowhere else. Rows of (start in x, length, period),
    by start, then period."""
    if least_times < 4:
        raise ValueError("seeds are certain for four periods or more")
    found: list[tuple[int, int, int]] = []

    def least(q: int) -> int:
        return max(least_words, least_times * q)

    longest = int(size.max(initial=0))
    for q in range(1, SHORT + 1):
        if longest < least(q):
            break
        # across a separator fewer than q neighbouring places agree, which is too few
        same = np.nonzero(x[:-q] == x[q:])[0]
        if not len(same):
            continue
        first = np.nonzero(np.r_[True, np.diff(same) > 1])[0]
        n = np.diff(np.r_[first, len(same)]) + q
        long = n >= least(q)
        found += [(s, m, q) for s, m in zip(same[first[long]].tolist(), n[long].tolist()) if _smallest(x, s, q)]
    k, place, h = 1, np.arange(len(x)), _mixed(x.astype(np.uint64) + _ODD)
    while longest >= least(k // 2 + 1 if k > SHORT else SHORT + 1):
        if k > SHORT:
            at, lag = _seeds(h, k)
            order = np.lexsort((at, lag))
            stop, of = -1, 0
            for p, q in zip(place[at[order]].tolist(), lag[order].tolist()):
                if q == of and p < stop:
                    continue  # in the stretch just extended
                right = _reach(lambda i, j: x[p + i:p + j] != x[p + q + i:p + q + j], max(0, len(x) - p - q))
                left = _reach(lambda i, j: (x[p - j:p - i] != x[p + q - j:p + q - i])[::-1], p)
                stop, of = p + max(right, 1), q
                if left + right + q >= least(q) and _smallest(x, p - left, q):
                    found.append((p - left, left + right + q, q))
        # texts too short for the next scale go
        keep = size >= least(max(k, SHORT) + 1)
        if not keep.all():
            still = np.repeat(keep, size + 1)
            size, place, h = size[keep], place[still], h[still]
        if len(h) > k:
            h[:-k] = _mixed(h[:-k] * np.uint64(3) + h[k:])  # the last ones would go over the end
        k *= 2
    return np.array(sorted(set(found), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _blocks(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(raw):
        if i > first and size + len(t) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(raw):
        yield first, len(raw)


def collapse(words: list[list[bytes]], least_words: int = 6, least_times: int = 4) -> list[tuple[np.ndarray, bytes]]:
    """(runs, text without the repeated periods) of texts given as words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    known: dict[bytes, int] = {}
    for w in words:
        known.update(dict.fromkeys(w))
    known = dict(zip(known, range(len(known))))
    ids: list[int] = []
    for i, w in enumerate(words):
        ids += map(known.__getitem__, w)
        ids.append(-1 - i)
    x = np.array(ids, np.int64)
    runs = find_runs(x, size, least_words, least_times)
    first = np.cumsum(size + 1) - (size + 1)
    depth = np.zeros(len(x) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(depth[:-1]) > 0
    cuts = np.searchsorted(runs[:, 0], np.r_[first, len(x)])
    out = []
    for i, w in enumerate(words):
        mine = runs[cuts[i]:cuts[i + 1]] - [first[i], 0, 0]
        if len(mine):
            w = [w[j] for j in np.nonzero(~gone[first[i]:first[i] + size[i]])[0].tolist()]
        out.append((mine, b" ".join(w)))
    return out


def periodic_runs(docs: DataFrame, text_col: str = "text", least_words: int = 6, least_times: int = 4,
                  id_col: str | None = None, reorder: Reorder | None = None) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words) and ``collapsed``: the
    words that are left, joined by single spaces. ``reorder`` (with ``id_col``) rearranges the
    words of chosen documents first, to plant runs with known periods."""
    refuse_clash(docs, ("runs", "collapsed"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            runs, left = [], []
            raw = [t.encode("utf-8", "replace") for t in texts]
            for first, last in _blocks(raw):
                words = [t.split() for t in raw[first:last]]
                if reorder is not None:
                    for i, (key, w) in enumerate(zip(ids.iloc[first:last], words)):
                        index = reorder(key, len(w))
                        if index is not None:
                            words[i] = [w[j] for j in index.tolist()]
                for found, text in collapse(words, least_words, least_times):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found.tolist()])
                    left.append(text.decode("utf-8", "replace"))
            yield pd.DataFrame({"runs": pd.Series(runs, dtype=object), "collapsed": pd.Series(left, dtype=object)})
        give_back()

    kind = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    key = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    got = docs.withColumn("__runs", F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(key, text_or_empty(text_col)))
    return got.select(*docs.columns, F.col("__runs.runs").alias("runs"), F.col("__runs.collapsed").alias("collapsed"))


def planted_period(key: str | None, n: int) -> np.ndarray | None:
    """A reorder for drills: in every tenth document by the CRC-32 h of its id, the words from
    place a on repeat with a period p that depends on h, where n words give less than 3 to 10 periods."""
    if key is None or not n:
        return None
    h = zlib.crc32(key.encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, then the smallest start, then the smallest period;
    null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
