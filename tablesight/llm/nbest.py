"""N-best segmentation into SentencePiece pieces, and decoding.

The lattice over a text has an edge for every vocabulary piece that occurs in it, with
the piece's score; a character without a piece gets an edge of its byte pieces. Forward
Viterbi gives every position the loss and the fewest pieces of its best beginning: exactly
what a segmentation that continues to the left from there still has to pay. A backward A*
search with that heuristic takes partial segmentations from the end of the word in the order
of their best whole segmentation. A position is taken at most N times (a later one has N
better ones with the same beginning), so the queue stays within N times the edges, however many
segmentations tie. Viterbi scores of many words at once tell the words whose best
segmentation has no equal; only the others are searched for the best ids.

No piece of the vocabulary has the space mark after another character, or a line break
beside others (checked when the model is read), so the lattice falls apart there: words are searched by
themselves, and the N best of the text are combined from the words with the smallest
losses, which is exact.

Ties in score go to the segmentation with fewer pieces, then to the smaller ids in
order (scores whose sums are not exact in doubles tie up to their rounding). A table that
already has a column of an added name is refused. Nulls, empties: a null text counts as empty; an empty text has one segmentation
without pieces and a score of 0. A text with fewer than N segmentations returns all it
has. Texts of any length are handled whole; a word longer than ``LONG_WORD`` characters is
searched like any other but not memorised. Repeated rows get equal results;
extra columns pass through.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from itertools import chain, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import refuse_clash, text_or_empty

SPACE = "▁"
MEMO = 400_000
LONG_WORD = 64
#: What a byte piece scores below the lowest ordinary piece.
BYTE_LOSS = 10.0
#: Pieces scored at or below this are not ordinary ones (models mark runs of spaces so).
NEVER = -1e8
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(43)
_WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

Segmentation = tuple[float, tuple[int, ...]]
#: Score, ids, loss of the second best, and whether the ids give the word back.
Best = tuple[float, tuple[int, ...], float, bool]


class PieceLattice:
    """Pieces and scores of a SentencePiece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m = self.model
        ids = range(m.get_piece_size())
        self.pieces = [m.id_to_piece(i) for i in ids]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in ids if m.is_byte(i)}
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) or ("\n" in self.pieces[i] and self.pieces[i] != "\n") for i in plain):
            raise ValueError("the model has pieces that go over word starts or lines")
        self.edges = {self.pieces[i]: (i, m.get_score(i)) for i in plain}
        self.byte_score = min((s for _, s in self.edges.values() if s > NEVER), default=0.0) - BYTE_LOSS
        self.unknown = m.unk_id()
        self._byte_of = {i: b for b, i in self.bytes.items()}
        #: Every beginning of a piece; with (id, score) where it is a piece itself.
        self.trie: dict[str, tuple[int, float] | None] = {p[:k]: None for p in self.edges for k in range(1, len(p) + 1)}
        self.trie.update(self.edges)
        #: The same for the endings of pieces.
        self.tails: dict[str, tuple[int, float] | None] = {p[k:]: None for p in self.edges for k in range(len(p))}
        self.tails.update(self.edges)
        with np.errstate(over="ignore"):
            base, size = 0x9E3779B97F4A7C15, 4096 * LONG_WORD + 1
            self._up = np.cumprod(np.r_[1, np.full(size, base, np.uint64)].astype(np.uint64), dtype=np.uint64)
            self._down = np.cumprod(np.r_[1, np.full(size, pow(base, -1, 1 << 64), np.uint64)].astype(np.uint64), dtype=np.uint64)
        self._piece_tables()
        self._single = {p for p in self.edges if len(p) == 1}
        self._young: dict[str, Best] = {}
        self._old: dict[str, Best] = {}
        self._memo: dict[str, list[Segmentation]] = {}
        self._memo_n = 0

    def normalized(self, text: str) -> str:
        """The text as the model sees it: its own normalisation, spaces as marks."""
        return self.model.normalize(text)

    def _edges(self, word: str, start: int) -> list[tuple[int, tuple[int, ...], float]]:
        """The pieces that begin at ``start``, as (end, ids, score)."""
        trie, out = self.trie, []
        for end in range(start + 1, len(word) + 1):
            hit = trie.get(word[start:end], False)
            if hit is False:
                break
            if hit is not None:
                out.append((end, (hit[0],), hit[1]))
        if trie.get(word[start]) is None:
            raw = word[start].encode("utf-8", "replace")
            ids = tuple(self.bytes.get(b, self.unknown) for b in raw) if self.bytes else (self.unknown,)
            out.append((start + 1, ids, self.byte_score * len(ids)))
        return out

    def _edges_into(self, word: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """The pieces that end at ``end``, as (start, ids, score)."""
        tails, out = self.tails, []
        for start in range(end - 1, -1, -1):
            hit = tails.get(word[start:end], False)
            if hit is False:
                break
            if hit is not None:
                out.append((start, (hit[0],), hit[1]))
        if tails.get(word[end - 1]) is None:
            raw = word[end - 1].encode("utf-8", "replace")
            ids = tuple(self.bytes.get(b, self.unknown) for b in raw) if self.bytes else (self.unknown,)
            out.append((end - 1, ids, self.byte_score * len(ids)))
        return out

    def _forward(self, word: str) -> list[tuple[float, int]]:
        """(loss, fewest pieces) of the best segmentation of every beginning of the word."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(min((best[start][0] - score, best[start][1] + len(ids)) for start, ids, score in self._edges_into(word, end)))
        return best

    def word_nbest(self, word: str, n: int) -> list[Segmentation]:
        """The ``n`` best (score, ids) of a word, best first, by backward A*.

        The queue is ordered by (loss, pieces) of the best whole segmentation that ends with
        the part found so far, then from right to left, then by (first id, rank of what
        follows it at its position). Edges lead to the left, so of equal losses and pieces
        all parts that begin further right are taken before; thus the parts of one position
        are all in the queue when the first of them is taken, and as pieces that begin
        at one position differ in their first id, they come out by (loss, pieces, ids)
        without a comparison of ids."""
        got = self._memo.get(word) if n == self._memo_n else None
        if got is not None:
            return got
        ahead = self._forward(word)
        taken = [0] * (len(word) + 1)
        # (loss and pieces of the whole, -position, first id, rank after it, loss and pieces of the part, ids as a linked list)
        queue: list[tuple] = [(*ahead[-1], -len(word), 0, 0, 0.0, 0, None)]
        out: list[Segmentation] = []
        while queue and len(out) < n:
            _, _, at, _, _, loss, count, link = heapq.heappop(queue)
            at = -at
            if taken[at] == n:
                continue
            rank = taken[at]
            taken[at] += 1
            if at == 0:
                path: list[int] = []
                while link is not None:
                    ids, link = link
                    path += ids
                out.append((0.0 - loss, tuple(path)))
                continue
            for start, ids, score in self._edges_into(word, at):
                if taken[start] < n:
                    part, pieces = loss - score, count + len(ids)
                    before = ahead[start]
                    heapq.heappush(queue, (before[0] + part, before[1] + pieces, -start, ids[0], rank, part, pieces, (ids, link)))
        if len(word) <= LONG_WORD:
            if n != self._memo_n or len(self._memo) >= MEMO:
                self._memo.clear()
                self._memo_n = n
            self._memo[word] = out
        return out

    def _piece_tables(self) -> None:
        """Hashes of the pieces in a table by their top bits; pieces whose slot is taken
        are kept aside, sorted."""
        by_length: dict[int, list[str]] = {}
        for p in self.edges:
            by_length.setdefault(len(p), []).append(p)
        self._lengths = sorted(by_length)
        hashes, pieces = [], []
        for n in self._lengths:
            code = np.frombuffer("".join(by_length[n]).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64) + np.uint64(1)
            hashes.append(((code * self._up[:n]).sum(axis=1, dtype=np.uint64) + np.uint64(n)) * _SPREAD)
            pieces += by_length[n]
        h = np.concatenate(hashes)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        self._hash = h
        self._ids = np.array([self.edges[p][0] for p in pieces])
        self._scores = np.array([self.edges[p][1] for p in pieces])
        slot = (h >> _SHIFT).astype(np.int64)
        self._slots = np.full(1 << (64 - int(_SHIFT)), -1, np.int32)
        self._slots[slot] = np.arange(len(h))
        aside = np.nonzero(self._slots[slot] != np.arange(len(h)))[0]
        self._aside = aside[np.argsort(h[aside])]

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, -1 where there is none."""
        found = self._slots[(h >> _SHIFT).astype(np.int64)]
        wrong = np.nonzero((found >= 0) & (self._hash[found] != h))[0]
        if len(wrong):
            rest = self._hash[self._aside]
            at = np.minimum(np.searchsorted(rest, h[wrong]), max(0, len(rest) - 1))
            found[wrong] = np.where(rest[at] == h[wrong], self._aside[at], -1) if len(rest) else -1
        return found

    def best_words(self, words: list[str]) -> dict[str, Best]:
        """(score, ids, loss of the second best, round trip) of every word, all lattices together.

        Words with a character that is no piece, very long ones, and those whose best
        segmentation has an equal go through the search for single words."""
        single = self._single
        plain = [w for w in words if len(w) <= LONG_WORD and single.issuperset(w)]
        out: dict[str, Best] = {}
        for i in range(0, len(plain), 4096):
            out.update(self._best_batch(plain[i:i + 4096]))
        for w in words:
            if w not in out:
                found = self.word_nbest(w, 2)
                ids = found[0][1]
                out[w] = (found[0][0], ids, found[0][0] - found[1][0] if len(found) > 1 else float("inf"), self.decode(ids) == w)
        return out

    def _best_batch(self, words: list[str]) -> dict[str, Best]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.r_[0, np.cumsum(lengths)]
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), lengths)
        n = len(code)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code * self._up[:n], out=sums[1:])
        starts, lengths_of, pieces = [], [], []
        for k in self._lengths:
            if k > n:
                break
            found = self._look_up(((sums[k:] - sums[:-k]) * self._down[:n - k + 1] + np.uint64(k)) * _SPREAD)
            hit = np.nonzero((found >= 0) & (word[k - 1:] == word[:n - k + 1]))[0]
            starts.append(hit)
            lengths_of.append(np.full(len(hit), k))
            pieces.append(found[hit])
        src, piece = np.concatenate(starts), np.concatenate(pieces)
        dst, ids, score = src + np.concatenate(lengths_of), self._ids[piece], self._scores[piece]
        of = word[src]
        # every word has a node before each character and one after its last
        a, b = src + of, dst + of
        low = np.full(n + len(words), -np.inf)
        forward, backward = low.copy(), low.copy()
        forward[first[:-1] + np.arange(len(words))] = 0.0
        end_node = first[1:] + np.arange(len(words))
        backward[end_node] = 0.0
        via = np.zeros(n + len(words), np.int64)
        place = dst - first[of]
        order = np.argsort(place, kind="stable")
        for e in np.split(order, np.nonzero(np.diff(place[order]))[0] + 1):
            reach = forward[a[e]] + score[e]
            np.maximum.at(forward, b[e], reach)
            top = reach == forward[b[e]]
            via[b[e][top]] = e[top]
        place = src - first[of]
        order = np.argsort(-place, kind="stable")
        for e in np.split(order, np.nonzero(np.diff(place[order]))[0] + 1):
            np.maximum.at(backward, a[e], score[e] + backward[b[e]])
        best = forward[end_node]
        on = np.zeros(len(src), bool)
        steps, at, open_ = [], end_node.copy(), np.arange(len(words))
        while len(open_):
            e = via[at[open_]]
            on[e] = True
            steps.append((open_, ids[e]))
            at[open_] = a[e]
            open_ = open_[src[e] > first[open_]]
        second = np.full(len(words), -np.inf)
        np.maximum.at(second, of[~on], (forward[a] + score + backward[b])[~on])
        owner = np.concatenate([w for w, _ in steps[::-1]])
        path = np.concatenate([i for _, i in steps[::-1]])
        order = np.argsort(owner, kind="stable")
        path, cuts = path[order].tolist(), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))].tolist()
        loss = best - second
        text = [self.pieces[i] for i in path]
        return {w: (s, tuple(path[cuts[i]:cuts[i + 1]]), x, "".join(text[cuts[i]:cuts[i + 1]]) == w)
                for i, (w, s, x) in enumerate(zip(words, best.tolist(), loss.tolist())) if x > 0}

    def best_of(self, words: list[str]) -> dict[str, Best]:
        """``best_words`` with a memo of two generations: what is used stays."""
        if len(self._young) >= MEMO:
            self._old, self._young = self._young, {}
        young, old, new = self._young, self._old, []
        for w in words:
            if w not in young:
                got = old.get(w)
                if got is None:
                    new.append(w)
                else:
                    young[w] = got
        if new:
            young.update(self.best_words(new))
        return young

    def nbest(self, normal: str, n: int) -> list[Segmentation]:
        """The ``n`` best segmentations of a normalised text."""
        words = [self.word_nbest(w, n) for w in _WORD.findall(normal)]
        total = sum(w[0][0] for w in words)
        # a word whose second choice costs more than those of n - 1 others keeps its best
        cost = [w[0][0] - w[1][0] if len(w) > 1 else float("inf") for w in words]
        most = max(heapq.nsmallest(n - 1, cost), default=-1.0)
        open_ = [i for i, x in enumerate(cost) if x <= most and x < float("inf")]
        # (loss, pieces, ids of the first open word, rank in the list after it, choices as a linked list);
        # no choice of a word is the beginning of another one, so this orders by the ids of the text
        changes: list[tuple] = [(0.0, 0, (), 0, None)]
        for i in reversed(open_):
            w = words[i]
            grown = [(x[0] + (w[0][0] - score), x[1] + len(ids), ids, rank, (i, k, x[4]))
                     for k, (score, ids) in enumerate(w) for rank, x in enumerate(changes)]
            grown.sort()
            changes = grown[:n]
        out = []
        for loss, _, _, _, link in changes:
            pick = {}
            while link is not None:
                i, k, link = link
                pick[i] = k
            out.append((total - loss, tuple(x for i, w in enumerate(words) for x in w[pick.get(i, 0)][1])))
        return out

    def decode(self, ids) -> str:
        """The normalised text of a segmentation (with space marks)."""
        back = self._byte_of
        if back.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in back:
                raw.append(back[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i])
        return "".join(out) + raw.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def lattice(model_file: str) -> PieceLattice:
    return PieceLattice(model_file)


def brute_nbest(pl: PieceLattice, word: str, n: int) -> list[Segmentation]:
    """All segmentations of a short word, sorted (for tests)."""
    ends: list[list] = [[] for _ in range(len(word) + 1)]
    for start in range(len(word)):
        for end, ids, score in pl._edges(word, start):
            ends[end].append((start, ids, score))

    @functools.lru_cache(maxsize=None)
    def upto(end: int) -> list[Segmentation]:
        if end == 0:
            return [(0.0, ())]
        return [(s + score, ids + piece) for start, piece, score in ends[end] for s, ids in upto(start)]

    return sorted(upto(len(word)), key=lambda x: (-x[0], len(x[1]), x[1]))[:n]


def encode_nbest(docs: DataFrame, model_file: str, n: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``segmentations``: the N best as an array of (score, ids), best first."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pl = lattice(model_file)
        for s in batches:
            yield s.map(lambda t: [{"score": sc, "ids": list(ids)} for sc, ids in pl.nbest(pl.normalized(t), n)])

    refuse_clash(docs, ["segmentations"])
    kind = "array<struct<score:double,ids:array<int>>>"
    return docs.withColumn("segmentations", F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(text_or_empty(text_col)))


def decode_ids(docs: DataFrame, ids_col: str, model_file: str, name: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of ids: space marks as spaces, without the one
    that the model puts before the text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pl = lattice(model_file)
        for s in batches:
            yield s.map(lambda ids: pl.model.decode([int(i) for i in ids]) if ids is not None else None)

    refuse_clash(docs, [name])
    return docs.withColumn(name, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(ids_col)))


def segmentation_digest(docs: DataFrame, model_file: str, n: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with the number of pieces, the scores of the N best, a CRC-32 of the best
    ids (as little-endian 32-bit numbers), and whether these ids give the normalised text back."""
    import zlib

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pl = lattice(model_file)
        for s in batches:
            out = []
            for at in range(0, len(s), 1024):
                split = [_WORD.findall(pl.normalized(t)) for t in s.iloc[at:at + 1024]]
                distinct = list({w for words in split for w in words})
                known = pl.best_of(distinct)
                found = [known[w] for w in distinct]
                score, loss = np.array([e[0] for e in found]), np.array([e[2] for e in found])
                size, whole = np.array([len(e[1]) for e in found], np.int64), np.array([e[3] for e in found], bool)
                flat = np.fromiter(chain.from_iterable([e[1] for e in found]), "<i4")
                start = np.cumsum(size) - size
                index = dict(zip(distinct, range(len(distinct))))
                every = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64)
                ends = np.cumsum([len(words) for words in split])
                for words, end in zip(split, ends.tolist()):
                    if not words:
                        out.append((0, [0.0], 0, True))
                        continue
                    w = every[end - len(words):end]
                    total, cost = float(score[w].sum()), loss[w]
                    pick = np.argpartition(cost, n - 2)[:n - 1] if 1 < n <= len(cost) else np.arange(len(cost) if n > 1 else 0)
                    near = [pl.word_nbest(words[i], n) for i in pick.tolist() if cost[i] < np.inf]
                    k = size[w]
                    ids = flat[np.repeat(start[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                    out.append((len(ids), [total, *(_small_sums(near, n, total) if near else [])], zlib.crc32(ids.tobytes()), bool(whole[w].all())))
            yield pd.DataFrame(out, columns=["n_pieces", "scores", "ids_crc32", "round_trip"])

    refuse_clash(docs, ["n_pieces", "scores", "ids_crc32", "round_trip", "__r"])
    kind = "n_pieces long, scores array<double>, ids_crc32 long, round_trip boolean"
    got = docs.withColumn("__r", F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(text_or_empty(text_col)))
    return got.select(*docs.columns, *[F.col(f"__r.{c}").alias(c) for c in ("n_pieces", "scores", "ids_crc32", "round_trip")])


def _small_sums(near: list[list[Segmentation]], n: int, total: float) -> list[float]:
    """Scores of the second to n-th best text: sums with one choice from each of the
    words whose second choice costs least."""
    losses = sorted(sum(c) for c in product(*[[w[0][0] - x[0] for x in w] for w in near]))
    return [total - loss for loss in losses[1:n]]
