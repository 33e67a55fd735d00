"""License notices in texts: exact phrases, and short notices with a bounded number of errors.

A text is lower-cased (A-Z) and reduced to its words (ASCII letters and digits, and every
character outside ASCII) joined by single spaces, so punctuation, line breaks and the
marks of comments do not matter.

1. Exact: places where a phrase's words stand one after another.
2. Fuzzy: a notice of m characters may differ by up to k edits (characters inserted, lost
   or changed; k is ``error_share`` of m). Cut into k + ``SEEDS`` pieces, at least ``SEEDS``
   pieces of the notice are in any such text unchanged and at most k places off (pigeonhole),
   so one automaton over all pieces and phrases finds the candidates in one pass. The text
   around them, long enough for k edits, is checked by the ``regex`` library with that
   bound; it gives the least number of edits and the place. Overlapping candidates of a
   notice are checked as one text.
3. Notices that differ in a version or a name are within each other's bounds. Of two that
   overlap by half of either, the one with fewer edits stays, of equal ones the longer.

``find_licenses`` returns the exact places and the fuzzy notices of every document; the
score is 1 where there is an exact phrase or an unchanged notice, otherwise that of the
best notice (1 - edits / characters), and 0 without any.

Nulls, empties: a null text counts as empty and has no words, labels or places; its score is
0. Texts of any length are handled whole. All places of an exact phrase count, overlapping
ones included, and keep their labels whatever the notices say. Notices come in order of
place, then label. Repeated rows get equal results; an
empty table gives an empty table. Extra columns pass through, but a table with columns
named as the added ones (``ADDED``) is refused.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, refuse_clash, text_or_empty

_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Short notices, as words, and their labels: sentences of public license texts ...
SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("use of this source code is governed by a bsd style license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is dedicated to the public domain under cc0 1 0 universal", "cc0"),
)
#: ... and the usual headers: one of the openings before one of the names.
OPENINGS = ("licensed under", "released under", "distributed under", "available under", "is under")
NAMES = (
    ("the mit license", "mit"),
    ("the isc license", "isc"),
    ("the bsd license", "bsd"),
    ("the bsd 3 clause license", "bsd"),
    ("the apache license version 2 0", "apache-2"),
    ("the mozilla public license version 2 0", "mpl-2"),
    ("the eclipse public license version 2 0", "epl-2"),
    ("the boost software license version 1 0", "bsl-1"),
    ("the gnu general public license version 2", "gpl-2"),
    ("the gnu general public license version 3", "gpl-3"),
    ("the gnu lesser general public license version 3", "lgpl-3"),
    ("the gnu affero general public license version 3", "agpl-3"),
    ("cc by 4 0", "cc-by"),
    ("cc by nc 4 0", "cc-by-nc"),
    ("cc by sa 4 0", "cc-by-sa"),
    ("cc by nd 4 0", "cc-by-nd"),
    ("a creative commons attribution 4 0 international license", "cc-by"),
    ("a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("a creative commons attribution noderivatives 4 0 international license", "cc-by-nd"),
)
NOTICES = (*SENTENCES, *((f"{opening} {name}", label) for opening in OPENINGS for name, label in NAMES))

#: Pieces of a notice that have to be found unchanged; it is cut into this many more than its errors.
SEEDS = 3
#: Verified texts kept in a worker's memo; it changes speed only.
MEMO = 100_000

ADDED = {"n_words": "long", "places": "array<struct<label:string,word:long>>",
         "notices": "array<struct<label:string,word:long,words:long,start:long,stop:long,inserted:int,lost:int,changed:int,edits:int>>",
         "score": "double"}


class Notice(NamedTuple):
    label: str
    words: str
    errors: int
    pieces: list[tuple[int, str]]


def pieces_of(words: str, n: int) -> list[tuple[int, str]]:
    """``n`` neighbouring pieces of near equal length, with their places."""
    edges = [len(words) * i // n for i in range(n + 1)]
    return [(s, words[s:e]) for s, e in zip(edges, edges[1:])]


class LicenseScanner:
    """One automaton for phrases and the pieces of notices."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, error_share: float = 0.08):
        import ahocorasick
        import regex

        if not 0 <= error_share <= 0.2:
            raise ValueError("error_share has to be 0 to 0.2")
        self.phrases = [(" ".join(_WORD.findall(p.lower())), label) for p, label in phrases]
        self.notices, self._match = [], []
        uses: dict[str, list[tuple[int, int]]] = {}
        for i, (p, _) in enumerate(self.phrases):
            uses.setdefault(f" {p} ", []).append((-1 - i, 0))
        for i, (text, label) in enumerate(notices):
            words = " ".join(_WORD.findall(text.lower()))
            k = int(len(words) * error_share)
            self.notices.append(Notice(label, words, k, pieces_of(words, k + SEEDS)))
            self._match.append(regex.compile(f"(?b)(?:{regex.escape(words, literal_spaces=True)}){{e<={k}}}"))
            for at, piece in self.notices[-1].pieces:
                uses.setdefault(piece, []).append((i, at))
        self._find = ahocorasick.Automaton()
        for piece, of in uses.items():
            self._find.add_word(piece, (len(piece), of))
        self._find.make_automaton()
        self._memo: dict[tuple[int, str], list[tuple]] = {}

    def _verify(self, i: int, text: str) -> list[tuple]:
        """(start, stop, inserted, lost, changed) of the notice's matches in a text around seeds."""
        got = self._memo.get((i, text))
        if got is None:
            # the best match, then the texts to both sides of it
            got, m = [], self._match[i].search(text)
            if m is not None:
                changed, inserted, lost = m.fuzzy_counts
                s, e = m.span()
                least = len(self.notices[i].words) - self.notices[i].errors
                before = self._verify(i, text[:s]) if s >= least else []
                after = self._verify(i, text[e:]) if len(text) - e >= least else []
                got = [*before, (s, e, inserted, lost, changed), *[(x + e, y + e, *c) for x, y, *c in after]]
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[i, text] = got
        return got

    def _near(self, i: int, line: str, seeds: list[tuple[int, int]]) -> list[tuple]:
        """Matches of a notice around its seeds, which are (where the notice would begin, piece)."""
        k, n = self.notices[i].errors, len(self.notices[i].words)
        spans: list[list[int]] = []
        seeds.sort()
        first = 0
        for j, (s, _) in enumerate(seeds):
            while seeds[first][0] < s - 2 * k:
                first += 1
            # pieces of one text are at most k off where it begins, so 2 k from each other
            if j - first + 1 >= SEEDS and len({p for _, p in seeds[first:j + 1]}) >= SEEDS:
                low, high = max(0, seeds[first][0] - k), min(len(line), s + n + k)
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                else:
                    spans.append([low, high])
        return [(low + s, low + e, *counts) for low, high in spans for s, e, *counts in self._verify(i, line[low:high])]

    def _best(self, found: list[tuple]) -> list[tuple]:
        """Of matches that overlap by half of either, the one with fewer edits, then the longer."""
        out: list[tuple] = []
        ends: list[tuple[int, int]] = []
        for x in sorted(found, key=lambda x: (sum(x[2:5]), x[0] - x[1], x[0], x[5])):
            at = bisect.bisect_left(ends, (x[0], x[1]))
            # matches that stay overlap by less than half, so only near neighbours can reach this one
            if any(2 * (min(x[1], e) - max(x[0], s)) >= min(x[1] - x[0], e - s) for s, e in ends[max(0, at - 4):at + 4]):
                continue
            ends.insert(at, (x[0], x[1]))
            out.append(x)
        return out

    def scan(self, text: str) -> tuple[int, list[tuple], list[tuple], float]:
        """(words, exact places, notices, score) of a text."""
        words = _WORD.findall(text.encode("utf-8", "replace").lower().decode())  # bytes.lower() is A-Z only
        line = f" {' '.join(words)} "
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (n, of) in self._find.iter(line):
            for i, at in of:
                hits.setdefault(i, []).append((end + 1 - n - at, at))
        if not hits:
            return len(words), [], [], 0.0
        places, found = [], []
        for i, starts in hits.items():
            if i < 0:
                places += [(s, self.phrases[-1 - i][1]) for s, _ in starts]
                continue
            found += [(*x, i) for x in self._near(i, line, starts)]
        found = self._best(found)
        places.sort()
        found.sort(key=lambda x: (x[0], self.notices[x[5]].label, x[1]))
        # word numbers: the spaces before a place, counted on from the place before it
        marks = sorted({s for s, _ in places} | {x for s, e, *_ in found for x in (s, e)})
        number, at, n = {}, 0, 0
        for m in marks:
            n += line.count(" ", at, m)
            at = m
            number[m] = n
        exact = [(label, number[s]) for s, label in places]
        fuzzy, best = [], 1.0 if exact else 0.0
        for s, e, inserted, lost, changed, i in found:
            edits = inserted + lost + changed
            best = max(best, 1.0 - edits / len(self.notices[i].words))
            # a match that begins within a word begins at that word
            first = number[s] if line[s] == " " else number[s] - 1
            last = number[e] - (line[e - 1] == " ")
            fuzzy.append((self.notices[i].label, first, max(1, last - first), s - 1, e - 1, inserted, lost, changed, edits))
        return len(words), exact, fuzzy, best


@functools.lru_cache(maxsize=2)
def scanner(phrases=PHRASES, notices=NOTICES, error_share: float = 0.08) -> LicenseScanner:
    return LicenseScanner(phrases, notices, error_share)


def find_licenses(docs: DataFrame, text_col: str = "text", phrases=PHRASES, notices=NOTICES, error_share: float = 0.08) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (label and first word of every exact phrase),
    ``notices`` (label, first word, number of words, start and stop as characters of the
    words joined by spaces, edits of each kind and together) and ``score``."""
    refuse_clash(docs, ADDED)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = scanner(phrases, notices, error_share)
        names = ("label", "word", "words", "start", "stop", "inserted", "lost", "changed", "edits")
        for s in batches:
            rows = [find.scan(t) for t in s]
            yield pd.DataFrame({
                "n_words": [r[0] for r in rows],
                "places": pd.Series([[dict(zip(names, x)) for x in r[1]] for r in rows], dtype=object),
                "notices": pd.Series([[dict(zip(names, x)) for x in r[2]] for r in rows], dtype=object),
                "score": [r[3] for r in rows]})
        give_back()

    kind = ", ".join(f"{c} {t}" for c, t in ADDED.items())
    got = docs.withColumn("__licenses", F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(text_or_empty(text_col)))
    return got.select(*docs.columns, *[F.col(f"__licenses.{c}").alias(c) for c in ADDED])
