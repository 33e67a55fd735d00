"""Alignment of the tokens of two tokenizers over the same text.

Tokenizer A is a byte-level BPE, tokenizer B a SentencePiece model; both cover the bytes
of a space and the text. Where a token of A and a token of B end at the same byte, the
text can be cut for both. ``shared_ends`` finds these cuts by divide and conquer: it looks
for a common end near the middle of an interval of A's tokens (by bisection in B's ends),
cuts there and goes on with both halves; an interval without a cut is a leaf, and the
tokens between two cuts are a group. All intervals of a batch of texts are halved together.

A link is a pair of a token of A and a token of B whose bytes overlap. ``link_counts``
counts for every pair of ids the documents that hold it linked. ``alignment_digest`` gives
per document how many of its links are the most frequent ones of their A id, and the sum of
the counts. Documents go through in bundles of bounded size: a bundle keeps its distinct
pairs once, so what is shuffled to the counts and back are the distinct pairs of a bundle,
not the links of a document, and no task gathers a frequent pair's documents.

Special tokens' strings are ordinary text. Nulls, empties, and texts whose tokens do not
give the bytes back (say, a literal U+2581) have no tokens: counts are 0, arrays empty and
the digest of groups is an empty string. Texts of any length are handled whole. Repeated
rows are documents of their own, also in the counts; ids may be null, numbers or strings. An
empty table gives an empty table. ``align_documents`` keeps extra columns but refuses a
table that has columns with the names it adds; the other functions return named columns only.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frames, give_back, refuse_clash, stored, text_or_empty
from .tokenization import library_tokenizer, odd_text, rank_encoder, read_ranks

SPACE = "▁"
_WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Characters of the words in a worker's memo; it changes speed only. The words of one call
#: are held whole, however many they are.
MEMO = 1 << 20
#: Characters of text whose tokens are handled together.
BLOCK = 1 << 18
#: Distinct pairs of its documents, at least, that close a bundle, ...
BUNDLE = 600_000
#: ... or so many documents: short or empty ones have few pairs or none.
BUNDLE_DOCS = 10_000


class Aligned(NamedTuple):
    """Tokens and groups of one text; ``a_upto[i]`` and ``b_upto[i]`` say where group i ends."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_upto: np.ndarray
    b_upto: np.ndarray
    keys: np.ndarray
    times: np.ndarray

    @property
    def links(self) -> int:
        return int(self.times.sum())


def _ragged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and where each range begins."""
    n = stop - start
    at = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - at, n), at


def shared_ends(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places in ``a`` (ascending) whose value is also in ``b`` (ascending), searched within
    the intervals low to high (exclusive) of places by divide and conquer."""
    far = np.int64(2) * len(a) + 2
    cuts, reach = [], np.zeros(len(low), np.int64)
    low, high = low.astype(np.int64), high.astype(np.int64)
    while True:
        some = low < high
        low, high, reach = low[some], high[some], reach[some]
        if not len(low):
            break
        middle = (low + high) // 2
        left, right = np.maximum(low, middle - reach), np.minimum(high, middle + reach + 1)
        place, at = _ragged(left, right)
        found = np.searchsorted(b, a[place])
        hit = b[np.minimum(found, len(b) - 1)] == a[place]
        off = place - np.repeat(middle, right - left)
        near = np.minimum.reduceat(np.where(hit, np.abs(off) * 2 + (off < 0), far), at)
        cut = near < far
        where = middle + np.where(near % 2 == 1, -(near // 2), near // 2)
        cuts.append(where[cut])
        on = ~cut & ((left > low) | (right < high))  # look farther from the middle
        low, high, reach = (np.concatenate(x) for x in (
            (low[cut], where[cut] + 1, low[on]), (where[cut], high[cut], high[on]),
            (np.zeros(2 * int(cut.sum()), np.int64), reach[on] * 3 + 1)))
    return np.sort(np.concatenate(cuts)) if cuts else np.zeros(0, np.int64)


class CrossTokenizer:
    """The two tokenizers, and the alignment of texts."""

    def __init__(self, tokenizer_json: str, ranks: str, pattern: str, model_file: str):
        import sentencepiece

        self._library = library_tokenizer(tokenizer_json, plain_specials=True)
        self._encoder = rank_encoder(ranks, pattern)
        table = read_ranks(ranks)
        self.a_bytes: list[bytes] = [b""] * (max(table.values()) + 1)
        for raw, i in table.items():
            self.a_bytes[i] = raw
        m = self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        ordinary = [p for i, p in enumerate(pieces) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in ordinary) or len(m.encode("\n")) != 2:
            raise ValueError("the model has pieces that go over word starts or lines")
        self._a_len = np.fromiter(map(len, self.a_bytes), np.int64)
        self._b_len = np.fromiter(map(len, self.b_bytes), np.int64)
        self.spread = len(self.b_bytes)
        self._line = m.encode("\n")[1]
        self._words: dict[str, int] = {}  # a word's number; its ids are a stretch of _flat
        self._chars = 0
        self._flat, self._start, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Ids as text with what may follow them: "," or "|" in A, "," or ";" in B.
        self._text = np.array([f"{i}{sep}" for n, last in ((len(self.a_bytes), "|"), (self.spread, ";")) for i in range(n) for sep in (",", last)], "S")

    def _a_encode(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "replace")
        if odd_text(text):
            ids = self._library.encode(text, add_special_tokens=False).ids
            return np.array(ids if b"".join([self.a_bytes[i] for i in ids]) == raw else [], np.int64)
        return np.array(self._encoder.encode_ordinary(text), np.int64)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, all in one call: pieces do not go over line breaks."""
        size = sum(map(len, words))
        if self._chars + size > MEMO:  # begun anew
            self._words.clear()
            self._flat, self._start, self._size = (np.zeros(0, np.int64) for _ in range(3))
            self._chars = 0
        self._chars += size
        apart = [w for w in words if w != "\n"]
        ids = np.array(self.model.encode("\n".join(["", *apart, ""]))[1:], np.int64)  # without the mark that the model adds
        line = np.nonzero(ids == self._line)[0]
        start, size = line[:-1] + 1, np.diff(line) - 1
        if len(apart) < len(words):
            apart.append("\n")
            start, size = np.r_[start, 0], np.r_[size, 1]
        self._words.update(zip(apart, range(len(self._words), len(self._words) + len(apart))))
        self._start = np.r_[self._start, start + len(self._flat)]
        self._size = np.r_[self._size, size]
        self._flat = np.r_[self._flat, ids]

    def _b_encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has; none for a text that the
        model's normalisation changes beyond the space before it."""
        split = []
        for t in texts:
            normal = self.model.normalize(t) if t else ""
            split.append(_WORD.findall(normal) if normal.replace(SPACE, " ") == " " + t else [])
        words, known = set().union(*split), self._words
        new = [w for w in words if w not in known]
        if new:
            self._learn(sorted(words) if self._chars + sum(map(len, new)) > MEMO else sorted(new))
        word = np.fromiter(map(self._words.__getitem__, chain.from_iterable(split)), np.int64)
        size, start = self._size[word], self._start[word]
        ids = self._flat[_ragged(start, start + size)[0]]
        upto = np.r_[0, np.cumsum(size)][np.cumsum([0, *map(len, split)])]
        return ids, np.diff(upto)

    def align(self, texts: list[str]) -> list[Aligned]:
        """Alignments of texts, all their intervals halved together."""
        none = np.zeros(0, np.int64)
        b, size_b = self._b_encode(texts)
        if self.model.unk_id() in b:
            raise ValueError("the model has no pieces for some bytes")
        each_a = [self._a_encode(" " + t) if n else none for t, n in zip(texts, size_b.tolist())]
        size_a = np.fromiter(map(len, each_a), np.int64, len(texts))
        lost = (size_a == 0) & (size_b > 0)
        if lost.any():
            b, size_b = b[np.repeat(~lost, size_b)], np.where(lost, 0, size_b)
        a = np.concatenate([none, *each_a])
        if not len(a):
            return [Aligned(none, none, none, none, none, none) for _ in texts]
        to_a, to_b = np.cumsum(size_a), np.cumsum(size_b)
        end_a, end_b = np.cumsum(self._a_len[a]), np.cumsum(self._b_len[b])  # texts have equal bytes in both
        some = size_a > 0
        last = to_a[some] - 1  # a text's last ends are common
        if not np.array_equal(end_a[last], end_b[to_b[some] - 1]):
            raise ValueError("the tokenizers do not cover the same bytes")
        cut_a = np.sort(np.concatenate([last, shared_ends(end_a.astype(np.int32), end_b.astype(np.int32), to_a - size_a, to_a - 1)]))
        # between two neighbouring ends of either kind lies one link
        at_a, at_b = np.zeros(end_a[-1] + 1, np.int64), np.zeros(end_a[-1] + 1, np.int64)
        at_a[end_a], at_b[end_b] = 1, 1
        every = np.nonzero(at_a | at_b)[0]
        of_a, of_b = (np.cumsum(x)[every] - x[every] for x in (at_a, at_b))  # tokens that end before
        cut_b = np.cumsum(at_b)[end_a[cut_a]] - 1
        key = a[of_a] * self.spread + b[of_b]
        doc = np.repeat(np.arange(len(texts)), size_a)[of_a]
        pairs = np.int64(len(self.a_bytes)) * self.spread
        pair, times = np.unique(doc * pairs + key, return_counts=True)
        at = np.searchsorted(pair, np.arange(len(texts) + 1) * pairs)
        cut_at = np.r_[0, np.searchsorted(cut_a, to_a)]
        pair %= pairs
        out = []
        for i, (sa, ea, sb, eb, c, d, p, q) in enumerate(zip(*(x.tolist() for x in (
                to_a - size_a, to_a, to_b - size_b, to_b, cut_at[:-1], cut_at[1:], at[:-1], at[1:])))):
            out.append(Aligned(a[sa:ea], b[sb:eb], cut_a[c:d] + (1 - sa), cut_b[c:d] + (1 - sb), pair[p:q], times[p:q]))
        return out

    def groups_text(self, x: Aligned) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups in order."""
        n = len(x.a_ids)
        if not n:
            return b""
        size_a, size_b = np.diff(x.a_upto, prepend=0), np.diff(x.b_upto, prepend=0)
        code = np.concatenate([x.a_ids, x.b_ids + len(self.a_bytes)]) * 2
        code[x.a_upto - 1] += 1
        code[x.b_upto - 1 + n] += 1
        out = np.empty(len(code), np.int64)
        out[np.arange(n) + np.repeat(x.b_upto - size_b, size_a)] = code[:n]
        out[np.arange(len(x.b_ids)) + np.repeat(x.a_upto, size_b)] = code[n:]
        chars = self._text[out].view(np.uint8)
        return chars[chars != 0].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def cross_tokenizer(tokenizer_json: str, ranks: str, pattern: str, model_file: str) -> CrossTokenizer:
    return CrossTokenizer(tokenizer_json, ranks, pattern, model_file)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``BLOCK`` characters together, or one text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


ADDED = {"a_ids": "array<int>", "b_ids": "array<int>", "a_upto": "array<int>", "b_upto": "array<int>"}


def align_documents(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, model_file: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the ids of both tokenizers and, per group, where it ends in each."""
    refuse_clash(docs, ADDED)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ct = cross_tokenizer(tokenizer_json, ranks, pattern, model_file)
        for s in batches:
            texts = s.tolist()
            found = [x for i, j in _blocks(texts) for x in ct.align(texts[i:j])]
            yield pd.DataFrame({c: [getattr(x, c).astype(np.int32) for x in found] for c in ADDED})

    kind = ", ".join(f"{c} {t}" for c, t in ADDED.items())
    got = docs.withColumn("__aligned", F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(text_or_empty(text_col)))
    return got.select(*docs.columns, *[F.col(f"__aligned.{c}").alias(c) for c in ADDED])


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits as compressed differences: the JVM handles them as one short value,
    where an array of them would be copied and kept by number."""
    return zlib.compress(np.diff(x, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<i4"), dtype=np.int64)


def _bundles(docs: DataFrame, files: tuple[str, str, str, str], text_col: str, id_col: str) -> DataFrame:
    """Bundles of documents: their counts and digests as arrays, the distinct pairs of the
    bundle (``keys``, ascending) with the documents that hold each (``held``), and, packed, for
    all documents one after another their pairs as places in ``keys`` with how often each occurs."""
    from pyspark import TaskContext

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ct = cross_tokenizer(*files)
        rows: list[tuple] = []
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        number = TaskContext.get().partitionId() << 32

        def bundle() -> pd.DataFrame:
            nonlocal number
            every = np.concatenate(keys)
            distinct, place, held = np.unique(every, return_inverse=True, return_counts=True)
            one = {"bundle": number, "id": [r[0] for r in rows], "groups_sha256": [r[1] for r in rows],
                   **{c: [r[2 + i] for r in rows] for i, c in enumerate(_COUNTS)},
                   "keys": distinct, "held": held, "place": _packed(place), "times": _packed(np.concatenate(times))}
            number += 1
            rows.clear(), keys.clear(), times.clear()
            return pd.DataFrame({k: [v] for k, v in one.items()})

        for pdf in frames(it):
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            for first, last in _blocks(texts):
                for i, x in zip(ids[first:last], ct.align(texts[first:last])):
                    text = ct.groups_text(x)
                    rows.append((i, hashlib.sha256(text).hexdigest() if text else "",
                                 len(x.a_ids), len(x.b_ids), len(x.a_upto), x.links, len(x.keys)))
                    keys.append(x.keys)
                    times.append(x.times)
                if len(rows) >= BUNDLE_DOCS or sum(map(len, keys)) >= BUNDLE:
                    yield bundle()
                    give_back()
        if rows:
            yield bundle()

    schema = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("id", T.ArrayType(T.StringType())),
                           T.StructField("groups_sha256", T.ArrayType(T.StringType())),
                           *[T.StructField(c, T.ArrayType(T.LongType())) for c in _COUNTS],
                           T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.LongType())),
                           T.StructField("place", T.BinaryType()), T.StructField("times", T.BinaryType())])
    return stored(docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(run, schema))


def _pairs(bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bundle, place, key) rows, and the documents of every key."""
    rows = bundles.select("bundle", F.posexplode(F.arrays_zip("keys", "held")).alias("place", "x")).select(
        "bundle", "place", F.col("x.keys").alias("key"), F.col("x.held").alias("held"))
    return rows, rows.groupBy("key").agg(F.sum("held").alias("n_docs"))


def link_counts(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, model_file: str,
                text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(a_id, b_id, n_docs): in how many documents a token of A and one of B are linked."""
    files = tokenizer_json, ranks, pattern, model_file
    spread = _spread(model_file)
    _, counts = _pairs(_bundles(docs, files, text_col, id_col))
    return counts.select(F.floor(F.col("key") / spread).cast("int").alias("a_id"), (F.col("key") % spread).cast("int").alias("b_id"), "n_docs")


def _spread(model_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size()


def alignment_digest(docs: DataFrame, tokenizer_json: str, ranks: str, pattern: str, model_file: str,
                     text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    bundles = _bundles(docs, (tokenizer_json, ranks, pattern, model_file), text_col, id_col)
    rows, counts = _pairs(bundles)
    of_a = F.floor(F.col("key") / _spread(model_file))
    top = counts.groupBy(of_a.alias("a")).agg(F.max("n_docs").alias("top"))
    scored = counts.join(top, of_a == F.col("a")).select("key", F.shiftleft(F.col("n_docs"), 1).bitwiseOR(
        (F.col("n_docs") == F.col("top")).cast("long")).alias("value"))
    # place, documents and the mark of the best in one number: lists of numbers are arrays in Python
    back = rows.join(scored, "key").groupBy(F.col("bundle").alias("__bundle")).agg(
        F.collect_list(F.shiftleft(F.col("place").cast("long"), 42).bitwiseOR(F.col("value"))).alias("values"))
    joined = bundles.drop("keys", "held").join(back, F.col("bundle") == F.col("__bundle"), "left")
    kind = docs.schema[id_col].dataType

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames(it):
            for r in pdf.itertuples(index=False):
                value = np.sort(np.asarray(r.values if r.values is not None else [], np.int64)) & ((1 << 42) - 1)
                times = _unpacked(r.times)
                mine = value[_unpacked(r.place)] if len(times) else times
                upto = np.r_[0, np.cumsum(np.asarray(r.n_pairs, np.int64))]
                best, total = (np.r_[0, np.cumsum(x * times)] for x in (mine & 1, mine >> 1))
                yield pd.DataFrame({"id": pd.Series(list(r.id), dtype=object), **{c: getattr(r, c) for c in _COUNTS[:4]},
                                    "n_best": np.diff(best[upto]), "count_sum": np.diff(total[upto]), "groups_sha256": r.groups_sha256})

    out = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(c, T.LongType()) for c in (*_COUNTS[:4], "n_best", "count_sum")],
                        T.StructField("groups_sha256", T.StringType())])
    return joined.mapInPandas(run, out).select(F.col("id").cast(kind).alias(id_col), *out.names[1:])
