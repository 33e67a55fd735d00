"""Periodic runs against a search of all lags."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablesight.llm.common import table
from tablesight.llm.periodic import collapse, find_runs, periodic_runs
from tablesight.llm.queries import QUERIES

from llm_rows import ODD_ROWS

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch at every lag; of one stretch the smallest lag counts."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                s = words[i:j + q]
                smallest = next(d for d in range(1, q + 1) if s[d:] == s[:-d])
                if smallest == q:
                    found[i, q] = (i, j - i + q, q)
            i = max(j, i + 1)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {j for s, n, q in runs for j in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def texts(draw):
    out = []
    for _ in range(draw(st.integers(1, 5))):
        text = draw(st.lists(st.sampled_from("abc"), max_size=12))
        for _ in range(draw(st.integers(0, 2))):
            unit = [draw(st.sampled_from("abcdefgh")) for _ in range(draw(st.integers(1, 70)))]
            n = draw(st.integers(1, 6)) * len(unit) + draw(st.integers(0, len(unit)))
            text += (unit * 7)[:n] + draw(st.lists(st.sampled_from("abc"), max_size=4))
        out.append(text)
    return out


@settings(max_examples=300, deadline=None)
@given(texts())
def test_runs_equal_all_lags(found):
    got = collapse([[w.encode() for w in t] for t in found])
    for t, (runs, left) in zip(found, got):
        expected = brute_runs(t)
        assert [tuple(r) for r in runs.tolist()] == expected
        assert left.decode() == brute_collapsed(t, expected)


def test_long_periods_and_nested_runs():
    rnd = np.random.default_rng(3)
    for period, times in ((9, 4), (16, 5), (17, 4), (100, 4), (513, 4), (1000, 7)):
        unit = [f"w{x}" for x in rnd.integers(0, 50, period)]
        unit[:6] = ["z"] * 6  # a run of period 1 inside each period
        words = ["head"] * 3 + unit * times + unit[:period // 2] + ["tail"]
        (runs, _), = collapse([[w.encode() for w in words]])
        expected = [(3, period * times + period // 2, period)] + [(3 + i * period, 6, 1) for i in range(times + (period // 2 >= 6))]
        assert [tuple(r) for r in runs.tolist()] == sorted(expected, key=lambda r: (r[0], r[2]))
    assert find_runs(np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 3)


def brute_rows(rows):
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if doc_id is not None and h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out.append((doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
                    hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                    hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def write(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query_on_odd_rows(spark, docs_of, tmp_path):
    rows = ODD_ROWS + [(i, " ".join(f"w{j * j % 97}" for j in range(40 + 13 * i))) for i in range(30, 90)]
    rows += [(100, "a b\tc\x0bd\x0ce\x1fd é f " * 9), (101, " ".join("xyxyxyxyzzzzzz" * 4))]
    got = QUERIES["op12_periodic_runs"](spark, write(spark, docs_of(rows, extra=True), tmp_path))
    assert order(map(tuple, got.collect())) == order(brute_rows(rows))


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    expected = brute_rows([r for r in rows if len(r[1] or "") < 6_000])
    ids = {r[0] for r in expected}
    assert len(got) == len(rows)
    assert order(tuple(r) for r in got if r.doc_id in ids) == order(expected)
    assert any(r.n_runs and r.period > 8 for r in got)


def test_texts_of_the_operator(spark, docs_of):
    got = periodic_runs(docs_of([(1, "x  y " * 6 + "end"), (2, None)])).select("doc_id", "runs", "collapsed").collect()
    assert [(r.start, r.length, r.period) for r in got[0].runs] == [(0, 12, 2)] and got[0].collapsed == "x y end"
    assert got[1].runs == [] and got[1].collapsed == ""
    assert periodic_runs(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs_of([]).selectExpr("*", "1 as Runs"))
