"""Removal of repeated byte strings with sparse, bucketed suffix sorting.

A byte goes if it lies in a string of ``min_bytes`` bytes that also starts anywhere else
in the table (overlaps and the same document included); all strings are judged on the
input.

Every ``min_bytes`` window has one anchor: the position, within it, of the 32-byte gram
with the smallest hash. Equal windows have their anchors at the same place, so only the
suffixes that start at anchors (one in about ``min_bytes`` / 2 bytes), and the reversed
prefixes that end there, have to be sorted, in buckets of equal anchor grams:

1. One pass over the texts gives the anchors. Each comes with the run of windows that
   it serves, and a hash of the bytes that the run covers. Anchors of one text whose equal
   runs follow each other without a gap, as in periodic text, stay one row. Only buckets
   that hold two anchors or more go on.
2. Anchors of a bucket whose runs cover equal bytes are one class. In a class of two or
   more, all windows of the run are repeated.
3. One string per class is fetched from the texts, for buckets in which some class has
   one member. A bucket is sorted both ways by ``deep_shallow_sort``; the longest common
   extensions to the left and right of the anchor of two strings, where together they
   reach ``min_bytes``, are the repeated bytes.
4. Buckets with more than ``BUCKET`` classes (a passage of very many documents) are not
   gathered: each of their windows becomes a row, and equal windows of one offset are
   counted by a distributed group-by. This gives the same spans.

Texts are compared as 64-bit hashes of the text beside their length when spans are
brought back to the documents; copies of one text are handled once.

Nulls, empties: a null text counts as empty; texts shorter than ``min_bytes`` stay as
they are. Repeated rows are copies of each other, so a text of ``min_bytes`` or more
that occurs twice goes entirely. Very long texts are scanned in chunks whose windows
overlap. Ties between grams go to the leftmost. An empty table gives an empty table;
extra columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, frames, refuse_clash, stored, text_or_empty
from .suffix_sort import deep_shallow_sort

GRAM = 32
#: Classes of one bucket that a task gathers and sorts (its two matrices of common lengths
#: have 32 MB each); larger buckets are counted by windows.
BUCKET = 4_000
#: Windows of a text scanned at a time.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = (CHUNK + 4096)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.full(n + 1, _BASE, np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Scan:
    """Rolling hashes of one byte string."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        size = _STEP if self.n <= _STEP else 1 << self.n.bit_length()
        up, self.down = _powers(size)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:self.n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every string of ``size`` bytes, by its start."""
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.down[:self.n - size + 1])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(raw: bytes, min_bytes: int) -> tuple[np.ndarray, ...]:
    """(gram hash, run hash, anchor, first window, last window) of a text's anchors."""
    found = []
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(raw) - min_bytes + 1), CHUNK):
        piece = whole[at:at + CHUNK + min_bytes - 1]
        scan = Scan(piece)
        gram = scan.windows(GRAM)
        bits = np.uint64(int(len(gram)).bit_length())
        key = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
        width, size, low = min_bytes - GRAM + 1, 1, key
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:len(key) - width + 1], low[width - size:width - size + len(key) - width + 1])
        place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # anchor of each window
        first = np.nonzero(np.r_[True, place[1:] != place[:-1]])[0]
        last = np.r_[first[1:] - 1, len(place) - 1]
        a = place[first]
        run = _mixed(scan.spans(first, last + min_bytes) ^ _mixed(gram[a] ^ ((a - first) * 4096 + (last - first)).astype(np.uint64)))
        found.append((gram[a], run, a + at, first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


#: A place packs the first window's start, the anchor's distance from it and the number
#: of further windows of the run into one long: start << 24 | distance << 12 | further.
def _place(s: np.ndarray, a: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (s << 24) | ((a - s) << 12) | (e - s)


def _chains(run: np.ndarray, s: np.ndarray, e: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """From one text's anchors in ascending order: the first of each chain of equal runs
    without a gap between them, and what follows it (bytes << 32 | anchors)."""
    order = np.argsort(run, kind="stable")
    r, start, end = run[order], s[order], e[order] + min_bytes
    first = np.nonzero(np.r_[len(r) > 0, (r[1:] != r[:-1]) | (start[1:] > end[:-1])])[0]
    last = np.r_[first[1:], len(r)][:len(first)] - 1
    return order[first], ((end[last] - end[first]) << 32) | (last - first)


def _find_anchors(min_bytes: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(it):
            out = []
            for tk, text in zip(pdf["tk"], pdf["text"]):
                h, t, a, s, e = anchors(text.encode("utf-8", "replace"), min_bytes)
                i, again = _chains(t, s, e, min_bytes)
                out.append((h[i].view(np.int64), t[i].view(np.int64), np.full(len(i), tk, np.int64), _place(s, a, e)[i], again))
            yield pd.DataFrame(dict(zip(("h", "run", "tk", "place", "again"), (np.concatenate(x) for x in zip(*out)))))

    return run


def _fetch(min_bytes: int):
    """From texts with their wanted anchors: the bytes that each anchor's run covers."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(it):
            out = []
            for tk, text, wanted in zip(pdf["tk"], pdf["text"], pdf["wanted"]):
                raw = text.encode("utf-8", "replace")
                out += [(w["h"], tk, w["place"], w["single"], w["large"], raw[w["place"] >> 24:(w["place"] >> 24) + (w["place"] & 4095) + min_bytes])
                        for w in wanted]
            yield pd.DataFrame(out, columns=["h", "tk", "place", "single", "large", "string"])

    return run


def _windows(min_bytes: int):
    """A row per window of the given strings: (w, o, tk, place, single) with a hash of bucket,
    offset and bytes, and the anchor's offset in the window."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(it):
            out = []
            for h, tk, place, single, string in pdf[["h", "tk", "place", "single", "string"]].itertuples(index=False):
                o = ((place >> 12) & 4095) - np.arange((place & 4095) + 1)
                w = Scan(np.frombuffer(string, np.uint8)).windows(min_bytes)
                with np.errstate(over="ignore"):
                    w = _mixed(w ^ _mixed(np.uint64(h & (2 ** 64 - 1)) + o.astype(np.uint64)))
                n = len(o)
                out.append((w.view(np.int64), o.astype(np.int32), np.full(n, tk, np.int64), np.full(n, place, np.int64), np.full(n, single, bool)))
            yield pd.DataFrame(dict(zip(("w", "o", "tk", "place", "single"), (np.concatenate(x) for x in zip(*out)))))

    return run


def large_windows(fetched: DataFrame, min_bytes: int) -> DataFrame:
    """The windows of the strings of large buckets. Those strings are few bytes but long work,
    so the number of tasks is given: adaptive execution would put them all into one."""
    key = ["h", "tk", "place"]
    parts = int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fetched.filter("large").repartition(parts, *key).dropDuplicates(key).mapInPandas(
        _windows(min_bytes), "w long, o int, tk long, place long, single boolean")


def extensions(strings: list[bytes], left: np.ndarray, bucket: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string (``left`` bytes before its anchor): the farthest reach to the left
    and right of the anchor of common parts with another string of its bucket that
    together have ``min_bytes`` bytes; -1 where there is none."""
    n = len(strings)
    order_r, lcp_r = deep_shallow_sort([s[k:] for s, k in zip(strings, left.tolist())], bucket)
    order_l, lcp_l = deep_shallow_sort([s[:k][::-1] for s, k in zip(strings, left.tolist())], bucket)
    reach_l, reach_r = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    sorted_bucket = bucket[order_r]
    starts = np.nonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]])[0]
    sizes = np.diff(np.r_[starts, n])
    two = starts[sizes == 2]
    if len(two):
        l, r = lcp_l[two + 1], lcp_r[two + 1]
        ok = l + r >= min_bytes
        for k in (0, 1):
            reach_l[order_r[two + k]] = np.where(ok, l, -1)
            reach_r[order_r[two + k]] = np.where(ok, r, -1)
    for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        common = []
        for order, lcp in ((order_r, lcp_r), (order_l, lcp_l)):
            c = np.zeros((m, m), np.int16)
            near = lcp[s:s + m].astype(np.int16)
            for i in range(m - 1):
                c[i, i + 1:] = np.minimum.accumulate(near[i + 1:])
            c = np.maximum(c, c.T)
            by = np.argsort(order[s:s + m])  # from sorted place to ascending index
            common.append(c[np.ix_(by, by)])
        members = np.sort(order_r[s:s + m])
        ok = common[0] + common[1] >= min_bytes
        np.fill_diagonal(ok, False)
        reach_r[members] = np.where(ok, common[0], np.int16(-1)).max(1)
        reach_l[members] = np.where(ok, common[1], np.int16(-1)).max(1)
    return reach_l, reach_r


def _sort_buckets(min_bytes: int, batch: int = 4096):
    """Rows of a partition, sorted by bucket, to spans. Whole buckets are sorted in batches."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "tk", "place"])
        place = pdf["place"].to_numpy(np.int64)
        left = (place >> 12) & 4095
        lo, hi = extensions(pdf["string"].tolist(), left, pd.factorize(pdf["h"])[0].astype(np.int64), min_bytes)
        some = (lo >= 0) & pdf["single"].to_numpy(bool)
        at = (place >> 24) + left
        return pd.DataFrame({"tk": pdf["tk"].to_numpy(np.int64)[some], "s": (at - lo)[some], "e": (at + hi)[some]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in it:
            for i in range(0, len(pdf), batch):
                held.append(pdf.iloc[i:i + batch])
                rows += len(held[-1])
                if rows < batch:
                    continue
                every = pd.concat(held, ignore_index=True)
                whole = (every["h"] != every["h"].iloc[-1]).to_numpy()  # the last bucket may go on
                if whole.any():
                    yield solve(every[whole])
                held = [every[~whole]]
                rows = len(held[0])
        if rows:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def repeated_spans(docs: DataFrame, min_bytes: int = 400, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(tk, spans) per text that has repeated bytes: ``tk`` is ``text_id`` of the text and
    ``spans`` an array of (s, e) byte ranges, which may overlap."""
    if not 2 * GRAM <= min_bytes <= 4096:
        raise ValueError(f"min_bytes has to be {2 * GRAM} to 4096")
    texts = docs.select(F.col(id_col).alias("rid"), text_or_empty(text_col).alias("text")).filter(F.octet_length("text") >= min_bytes).withColumn("tk", F.xxhash64("text"))
    # the scan is cheap and its rows are many: both uses of it run it, rather than storing it
    found = texts.select("tk", "text").mapInPandas(_find_anchors(min_bytes), "h long, run long, tk long, place long, again long")
    anchors_of_row = 1 + F.col("again").bitwiseAND(2 ** 32 - 1)
    often = stored(found.groupBy("h").agg(F.sum(anchors_of_row).alias("n")).filter("n > 1").select("h"))
    # grouped by the run, which stands for its gram too: a very common gram is one key of the join only
    occ = stored(found.join(often, "h").groupBy("run", "tk", "place", "again").agg(F.sum(anchors_of_row).alias("n"), F.first("h").alias("h")))
    classes = stored(occ.groupBy("run").agg(F.sum("n").alias("n"), F.min(F.struct("tk", "place")).alias("one"), F.first("h").alias("h")))
    known = classes.filter("n > 1").select("run")
    start, more = F.shiftright("place", 24), F.col("place").bitwiseAND(4095)
    spans = occ.join(known, "run").select("tk", start.alias("s"), (start + more + min_bytes + F.shiftright("again", 32)).alias("e"))
    open_ = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1")
    wanted = classes.join(open_.select("h", (F.col("m") > BUCKET).alias("large")), "h")
    wanted = wanted.groupBy(F.col("one.tk").alias("wtk")).agg(F.collect_list(F.struct(
        "h", F.col("one.place").alias("place"), (F.col("n") == 1).alias("single"), "large")).alias("wanted"))
    # of the copies of a text, only the one with the smallest id is fetched
    first = texts.groupBy("tk").agg(F.min("rid").alias("wid"))
    wanted = wanted.join(first, F.col("wtk") == F.col("tk")).select("wtk", "wid", "wanted")
    fetch = texts.join(wanted, (F.col("tk") == F.col("wtk")) & F.col("rid").eqNullSafe(F.col("wid")))
    fetched = cut(fetch.select("tk", "text", "wanted").mapInPandas(
        _fetch(min_bytes), "h long, tk long, place long, single boolean, large boolean, string binary"))
    small = fetched.filter("not large").repartition("h").sortWithinPartitions("h").mapInPandas(
        _sort_buckets(min_bytes), "tk long, s long, e long")
    windows = large_windows(fetched, min_bytes)
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w")
    anchor = start + F.shiftright("place", 12).bitwiseAND(4095)
    large = windows.filter("single").join(twice, "w").groupBy("tk", "place").agg(F.min("o").alias("o1"), F.max("o").alias("o2")).select(
        "tk", (anchor - F.col("o2")).alias("s"), (anchor - F.col("o1") + min_bytes).alias("e"))
    every = spans.unionByName(small).unionByName(large)
    return cut(every.groupBy("tk").agg(F.collect_list(F.struct("s", "e")).alias("spans")))


def text_id(text_col: str = "text"):
    """The key of ``repeated_spans`` for a text."""
    return F.xxhash64(text_or_empty(text_col))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that any span covers."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without_repeats(docs: DataFrame, min_bytes: int = 400, text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``
    (maximal removed runs); the text column itself is left out. A table that has columns with
    these names is refused."""
    refuse_clash(docs, ("kept", "n_bytes", "n_removed", "n_spans"))
    spans = repeated_spans(docs, min_bytes, text_col).select(F.col("tk").alias("__tk"), F.col("spans").alias("__spans"))
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*keep, text_or_empty(text_col).alias("__text")).withColumn("__key", F.xxhash64("__text"))
    joined = rows.join(spans, F.col("__key") == F.col("__tk"), "left")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for text, spans in zip(texts, found):
                raw = text.encode("utf-8", "replace")
                runs = merge_spans(spans) if spans is not None else []
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])) if runs else raw
                out.append((kept, len(raw) - len(kept), len(runs)))
            yield pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    apply = F.pandas_udf(run, "kept binary, n_removed long, n_spans long", F.PandasUDFType.SCALAR_ITER)
    got = joined.withColumn("__r", apply(F.col("__text"), F.col("__spans")))
    return got.select(*keep, F.col("__r.kept").alias("kept"), F.octet_length("__text").cast("long").alias("n_bytes"),
                      F.col("__r.n_removed").alias("n_removed"), F.col("__r.n_spans").alias("n_spans"))
