"""License scan against word-by-word phrase search and edit distances by dynamic programming."""

import random
import re

import pytest

from tablesight.llm.common import table
from tablesight.llm.licenses import NOTICES, LicenseScanner, find_licenses, scanner
from tablesight.llm.queries import QUERIES

from llm_rows import ODD_ROWS

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    words = words_of(text)
    found = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def least_edits(notice, line):
    """Smallest edit distance between the notice and any part of the line."""
    row = [0] * (len(line) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(line, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rnd, text, n):
    for _ in range(n):
        i = rnd.randrange(1, len(text) - 1)
        c = rnd.choice("abcdefgh")
        text = rnd.choice([text[:i] + c + text[i:], text[:i] + text[i + 1:], text[:i] + c + text[i + 1:]])
    return text


def test_bounded_errors_equal_dynamic_programming():
    rnd = random.Random(5)
    chosen = [NOTICES[0], NOTICES[3], NOTICES[9], ("released under the mit license", "mit"), ("licensed under cc by nc 4 0", "cc-by-nc")]
    found = missed = 0
    for notice, label in chosen:
        one = LicenseScanner(phrases=(), notices=((notice, label),))
        k = one.notices[0].errors
        for edits in [0, 1, k - 1, k, k + 1, k + 3, 2 * k + 2] * 8:
            text = f"some words before it {edited(rnd, notice, max(0, edits))} and a few after"
            line = f" {' '.join(words_of(text))} "
            least = least_edits(notice, line)
            got = one.scan(text)[2]
            assert bool(got) == (least <= k)
            if got:
                assert min(x[-1] for x in got) == least
                assert got[0][5] + got[0][6] + got[0][7] == got[0][8]
            found, missed = found + bool(got), missed + (not got)
    assert found > 60 and missed > 30


def test_spans_and_versions():
    s = scanner()
    n, places, notices, score = s.scan("# Licensed under the\n# GNU General Public License, version 2!\nEnd")
    assert (n, places, score) == (10, [], 1.0) and [(x[0], x[1], x[2]) for x in notices] == [("gpl-2", 0, 9)]
    # a word and a letter wrong: the nearest notice counts
    got = s.scan("x y Released under teh MIT Licence. z")[2]
    assert [(x[0], x[1]) for x in got] in ([], [("mit", 2)])
    n, places, notices, score = s.scan("Released undr the MIT License; released under the MIT license")
    assert places == [("mit", 6)] and score == 1.0 and [(x[0], x[1], x[8]) for x in notices] == [("mit", 0, 1), ("mit", 5, 0)]
    assert s.scan("Released undr the MIT License")[3] == pytest.approx(1 - 1 / 30)
    assert s.scan("licensed under cc by nc 4 0 licensed under cc by sa 4 0")[2][1][0] == "cc-by-sa"


def write(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def check(rows, got):
    for r in got:
        texts = [t for i, t in rows if i == r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in [base(t) for t in texts]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1.0 or not r.n_base) and (r.score > 0) == bool(r.labels)
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert len(got) == len(rows)


def test_query_on_odd_rows(spark, docs_of, tmp_path):
    rows = ODD_ROWS + [
        (30, "Under the MIT License under the MIT license, UNDER-THE.MIT/LICENSE"), (31, "apache license version 2.0 and CC BY-NC"),
        (32, "under the mit licenses"), (33, "apache license version 20"), (34, "É under the mit license é"), (35, "cc by nc " * 5000),
        (36, "released under the mit lisense"), (37, "ſunder the mit license K")]
    got = QUERIES["op13_license_scan"](spark, write(spark, docs_of(rows, extra=True), tmp_path)).collect()
    check(rows, got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[30].n_base == 3 and by_id[31].labels == "apache-2,cc-by-nc" and by_id[35].n_base == 5000 and by_id[35].last_word == 14997
    assert by_id[36].labels == "mit" and by_id[36].base_labels == "" and by_id[36].score == pytest.approx(1 - 1 / 30)


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    got = QUERIES["op13_license_scan"](spark, "/root/testdata/sf0.01").collect()
    check(rows, got)
    assert any(r.n_base for r in got)


def test_clashing_and_empty(spark, docs_of):
    assert find_licenses(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        find_licenses(docs_of([]).selectExpr("*", "1 as Score"))
    with pytest.raises(ValueError):
        LicenseScanner(error_share=0.5)
