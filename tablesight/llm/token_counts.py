"""Exact token counts at every prefix by prefix dynamic programming.

A byte-level BPE splits a text into chunks with a pattern and merges within chunks
only. Within a chunk, every byte prefix has exactly one encoding, and that encoding is
the encoding of a shorter prefix plus one last token. So one pass over the prefixes,
shortest first, finds the last token of each: the token that ends there, stands for
itself, and does not merge with the last token of the prefix before it. Counts are
then one more than the count of that shorter prefix. A text's count at a prefix is the
count of its whole chunks so far plus the count within the chunk.

``count_tokens`` gives the whole count (and, if wanted, the counts at all character
prefixes as an array); ``tokens_upto`` and ``longest_prefix`` answer budget and
truncation questions from that stored array with plain column functions.

Nulls, empties: a null text counts as empty; an empty text has 0 tokens. Very long
texts are processed whole; chunks without a break longer than ``LONG_CHUNK`` bytes are
not memorised. The special token's string counts as the library's default does (one
token), and its proper prefixes as ordinary text. Repeated rows get equal counts;
extra columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokenization import SPECIAL, read_ranks

#: Chunks kept in a worker's memo.
MEMO = 600_000
LONG_CHUNK = 256
#: Token pairs kept in a worker's memo.
PAIRS = 1_000_000


class PrefixCounter:
    """Prefix dynamic programming over one vocabulary of (bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self._split = regex.compile(pattern).findall
        self._chunk_iter = regex.compile(pattern).finditer
        #: Tokens that BPE makes of their own bytes; no other token can occur.
        self.whole = {t for t in ranks if len(self.merge(t)) == 1}
        self._apart: dict[tuple[bytes, bytes], bool] = {}
        self._memo: dict[str, int] = {}

    def merge(self, chunk: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: lowest rank first, leftmost on ties."""
        parts = [chunk[i:i + 1] for i in range(len(chunk))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[j] + parts[j + 1], 1 << 60), j) for j in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, left: bytes, right: bytes) -> bool:
        """True if the BPE of ``left + right`` is exactly these two tokens."""
        got = self._apart.get((left, right))
        if got is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            got = self._apart[left, right] = self.merge(left + right) == [left, right]
        return got

    def chunk_counts(self, chunk: bytes) -> list[int]:
        """Token counts of all byte prefixes of a chunk; the first entry is 0."""
        whole, longest, apart = self.whole, self.longest, self._apart.get
        last: list[bytes] = [b""]
        counts = [0]
        for end in range(1, len(chunk) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = chunk[start:end]
                if token in whole:
                    fits = start == 0 or apart((last[start], token))
                    if fits is None:
                        fits = self.stay_apart(last[start], token)
                    if fits:
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
            else:
                raise ValueError("vocabulary lacks a single byte")
        return counts

    def _chunk(self, chunk: str) -> int:
        raw = chunk.encode("utf-8", "replace")
        n = 1 if raw in self.whole else self.chunk_counts(raw)[-1]
        if len(chunk) <= LONG_CHUNK:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[chunk] = n
        return n

    def _plain(self, text: str) -> int:
        memo, total = self._memo.get, 0
        for chunk in self._split(text):
            n = memo(chunk)
            total += self._chunk(chunk) if n is None else n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if SPECIAL not in text:
            return self._plain(text)
        parts = text.split(SPECIAL)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to the text's length."""
        out = np.zeros(len(text) + 1, np.int32)
        base, at = 0, 0
        parts = text.split(SPECIAL)
        for k, part in enumerate(parts):
            tail, before = self._fill(part, out[at:at + len(part) + 1], base)
            at += len(part)
            base = int(out[at])
            if k < len(parts) - 1:
                # inside the special string its beginning is ordinary text behind the last chunk
                for i in range(1, len(SPECIAL)):
                    out[at + i] = before + self._plain(tail + SPECIAL[:i])
                at += len(SPECIAL)
                base += 1
                out[at] = base
        return out

    def _fill(self, text: str, out: np.ndarray, base: int) -> tuple[str, int]:
        """Counts of the prefixes of a text without special strings; returns what has to be
        split anew when more text follows (the last chunk, or the run of spaces) and the
        count before it."""
        out[0] = base
        spaces = 0  # start of the current run of white space; a prefix that ends in it has it as one chunk
        done, tail, before = base, "", base
        run: list[int] | None = None
        for m in self._chunk_iter(text):
            s, e = m.span()
            chunk = text[s:e]
            if chunk[0].isspace() and (s == 0 or not text[s - 1].isspace()):
                spaces, run_base, stop = s, done, s
                while stop < len(text) and text[stop].isspace():
                    stop += 1
                run = self._by_char(text[s:stop])
                run_end = stop
            counts = self._by_char(chunk)
            for i in range(1, e - s + 1):
                if run is not None and s + i <= run_end:
                    out[s + i] = run_base + run[s + i - spaces]
                elif chunk[0] == "'" and i == 2 and e - s > 2 and chunk[1].isalpha():
                    out[s + i] = done + self._plain(chunk[:1]) + self._plain(chunk[1:2])
                else:
                    out[s + i] = done + counts[i]
            before, done = done, done + counts[-1]
            out[e] = done if run is None or e > run_end or e == len(text) else out[e]
            tail = chunk
        if run is not None and text and text[-1].isspace():
            tail, before = text[spaces:], run_base
        return tail, before

    def _by_char(self, chunk: str) -> list[int]:
        raw = self.chunk_counts(chunk.encode("utf-8", "replace"))
        ends = np.cumsum([0] + [len(c.encode("utf-8", "replace")) for c in chunk])
        return [raw[i] for i in ends]


@functools.lru_cache(maxsize=2)
def counter(ranks_path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(read_ranks(ranks_path), pattern)


def count_tokens(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) of the whole text and, with ``prefixes``,
    ``prefix_tokens`` (array of int: the counts of all character prefixes, from the empty one)."""
    if prefixes:
        def run_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            c = counter(ranks, pattern)
            for s in batches:
                yield s.map(lambda t: c.prefix_counts(t))

        col = F.pandas_udf(run_all, "array<int>", F.PandasUDFType.SCALAR_ITER)(text_or_empty(text_col))
        return docs.withColumn("prefix_tokens", col).withColumn(
            "n_tokens", F.element_at("prefix_tokens", -1).cast("long"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(ranks, pattern)
        for s in batches:
            yield s.map(c.count).astype("int64")

    return docs.withColumn("n_tokens", F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)(text_or_empty(text_col)))


def tokens_upto(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters (the whole text if it is shorter)."""
    return F.element_at(prefix_tokens, (F.least(chars, F.size(prefix_tokens) - 1) + 1).cast("int"))


def longest_prefix(prefix_tokens: Column, budget: Column) -> Column:
    """Characters of the longest prefix that has at most ``budget`` tokens. Counts can
    fall as a prefix grows, so all prefixes are looked at."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))
    return F.array_max(fits)
