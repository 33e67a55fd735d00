import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesight.llm import fingerprints as fp
from tablesight.llm import suffix_dedup
from tablesight.llm.common import table
from tablesight.llm.queries import QUERIES
from tablesight.llm.suffix_sort import blind_trie_order, common_prefix, deep_shallow_sort

from llm_rows import ODD_ROWS


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(max_size=70).map(lambda b: bytes(97 + x % 2 for x in b))), min_size=1, max_size=30))
def test_deep_shallow_sort(rows):
    rows = [(b, b"z" * 55 * (b % 2) + s) for b, s in rows]  # long common prefixes in odd buckets
    order, lcp = deep_shallow_sort([s for _, s in rows], np.array([b for b, _ in rows]))
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for i in range(1, len(got)):
        same = got[i][0] == got[i - 1][0]
        assert lcp[i] == (common_prefix(got[i][1], got[i - 1][1]) if same else 0)


@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=25))
def test_blind_trie(strings):
    order = blind_trie_order(strings, list(range(len(strings))))
    assert [strings[i] for i in order] == sorted(strings)


def brute_keep(texts, size):
    """Per text: (removed bytes, maximal runs, kept bytes) by counting all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - size + 1):
            seen[r[i:i + size]] = seen.get(r[i:i + size], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if seen[r[i:i + size]] > 1:
                gone[i:i + size] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((int(gone.sum()), runs, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def check_repeats(docs_of, rows, size):
    got = suffix_dedup.without_repeats(docs_of(rows, extra=False), size).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("k"))
    got = sorted(map(tuple, got.collect()), key=str)
    want = [(i, len((t or "").encode()), n, k, hashlib.sha256(kept).hexdigest()) for (i, t), (n, k, kept) in zip(rows, brute_keep([t for _, t in rows], size))]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("bucket", [250, 2])
def test_repeats_against_brute_force(docs_of, monkeypatch, bucket):
    """Shared passages, edits near them, periodic text, exact copies; also by the window path."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (20, 25, 30, 60)]
    rows = []
    for i in range(40):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, 30)
            parts += [p[cut:] if rnd.random() < 0.5 else p[:len(p) - cut], text(rnd.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, "ab" * 400), (102, "x" * 300), (103, "ab" * 100 + "c" + "ab" * 100), (104, rows[5][1][:300] + rows[6][1])]
    for size in (64, 100):
        check_repeats(docs_of, rows, size)


def test_repeats_odd_rows(docs_of):
    check_repeats(docs_of, ODD_ROWS, 400)
    out = suffix_dedup.without_repeats(docs_of(ODD_ROWS, extra=True).drop("n", "h"), 400)
    assert out.count() == len(ODD_ROWS)


def test_windows_of_large_buckets_are_spread(spark):
    """Each window comes once, from more than one task, a frame for many strings."""
    rnd = random.Random(12)
    size, rows = 64, []
    for k in range(300):
        further = rnd.randint(0, 30)
        a = rnd.randint(further, 32)  # the gram of 32 bytes lies in every window
        s = rnd.randint(0, 500)
        rows.append((k % 2 - 1, k, (s << 24) | (a << 12) | further, k % 3 > 0, k % 50 > 0, bytes(rnd.choice(b"ab") for _ in range(size + further))))
    frame = pd.DataFrame(rows, columns=["h", "tk", "place", "single", "large", "string"])
    assert len(list(suffix_dedup._windows(size)(iter([frame[:100]])))) == 1
    fetched = spark.createDataFrame([*rows, *rows[:40]], "h long, tk long, place long, single boolean, large boolean, string binary")
    got = suffix_dedup.large_windows(fetched, size).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    want = [(h, o, tk, p, one, s[i:i + size]) for h, tk, p, one, large, s in rows if large
            for i, o in enumerate(range((p >> 12) & 4095, ((p >> 12) & 4095) - (p & 4095) - 1, -1))]
    assert sorted((r.o, r.tk, r.place, r.single) for r in got) == sorted(x[1:5] for x in want)
    by = {(r.tk, r.o): r.w for r in got}
    strings = {}  # equal hashes exactly for equal bucket, offset and bytes
    for h, o, tk, _, _, b in want:
        strings.setdefault((h, o, b), set()).add(by[tk, o])
    assert all(len(x) == 1 for x in strings.values()) and len(set().union(*strings.values())) == len(strings)


def test_periodic_text_is_few_rows(docs_of, spark):
    """A unit written over and over is a row or so of each text, not one for each time."""
    texts = ["of " * 3000, "x" + "of " * 2000, "ab" * 50 + " and then " + "of " * 900 + "some end " + "of " * 500, "no repeat here at all " + "z" * 30]
    rows = list(enumerate(texts))
    raw = pd.DataFrame({"tk": range(len(texts)), "text": texts})
    found = pd.concat(suffix_dedup._find_anchors(64)(iter([raw])))
    every = [suffix_dedup.anchors(t.encode(), 64) for t in texts]
    assert len(found) < 60 < 2000 < sum(len(x[0]) for x in every)
    assert (1 + (found["again"] & (2 ** 32 - 1))).sum() == sum(len(x[0]) for x in every)
    for tk, (_, run, _, s, e) in enumerate(every):  # the rows of a run cover what its anchors cover
        own = found[found["tk"] == tk]
        for r in np.unique(run):
            covered = {x for a, b in zip(s[run == r], e[run == r]) for x in range(a, b + 64)}
            of = own[own["run"] == r.astype(np.int64)]
            assert covered == {x for p, g in zip(of["place"], of["again"]) for x in range(p >> 24, (p >> 24) + (p & 4095) + 64 + (g >> 32))}
    check_repeats(docs_of, rows + [(9, texts[0]), (10, "of " * 25)], 64)


def test_repeats_in_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 150)
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcd") for _ in range(900))
    got = [suffix_dedup.anchors(t.encode(), 80) for t in (base, "zz" + base)]
    assert all((a[3] <= a[2]).all() and (a[4] >= a[3]).all() for a in got)
    assert sum(int((a[4] - a[3] + 1).sum()) for a in got[:1]) == 900 - 79


def test_repeats_empty_and_bounds(docs_of):
    assert suffix_dedup.without_repeats(docs_of([]), 400).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(docs_of([]), 10)


def test_query_returns_texts_without_passages(docs_of, tmp_path):
    """The result can be read as documents: ``text`` is what is left of each one, also where
    ``n_bytes`` says nothing about a removal."""
    rnd = random.Random(11)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    passage, short = words(55), words(45)  # 439 and 359 bytes
    rows = [(i, " ".join((words(20), passage, words(20)))) for i in range(4)] + [(i, words(30) + short) for i in (10, 11)]
    rows += [(20, words(200)), (21, "a few words"), (22, None), (23, "")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark = docs_of([]).sparkSession
    got = {r.doc_id: r for r in QUERIES["op4_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    for (i, text), (n, runs, kept) in zip(rows, brute_keep([t for _, t in rows], 400)):
        assert (got[i].text, got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (kept.decode(), len(text or ""), n, runs)
        assert (passage in (text or "")) == (i < 4) == (n > 0)
        assert passage not in got[i].text


def sets_of(text, k=5):
    w = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(df, rows):
    out = fp.fingerprint_documents(df, buckets=5).collect()
    assert len(out) == len(rows)
    ids = [i for i, _ in rows]
    if None in ids or len(set(ids)) < len(ids):
        return
    rows = sorted(rows)
    got = {r.doc_id: r for r in out}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[:len(t) - m] + nxt[:m]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(sets_of(t) | sets_of(edited)) < 128:  # sketches hold whole sets
            assert got[i].near_edited == pytest.approx(jaccard(sets_of(t), sets_of(edited)))
            if len(sets_of(t) | sets_of(nxt)) < 128:
                assert got[i].near_next == pytest.approx(jaccard(sets_of(t), sets_of(nxt)))
        else:
            assert abs(got[i].near_edited - jaccard(sets_of(t), sets_of(edited))) < 0.25


def test_fingerprints_odd_rows(docs_of):
    check_fingerprints(docs_of(ODD_ROWS, extra=True), ODD_ROWS)
    check_fingerprints(docs_of([r for k, r in enumerate(ODD_ROWS[2:]) if r[0] not in (3, 8)]), [r for r in ODD_ROWS[2:] if r[0] not in (3, 8)])
    check_fingerprints(docs_of([]), [])
    check_fingerprints(docs_of([(5, "one text alone in the table is next to itself")]), [(5, "one text alone in the table is next to itself")])


def test_fingerprints_fixture(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check_fingerprints(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_sketch_merge_containment_and_count(spark):
    words = [f"w{i}" for i in range(900)]
    rows = [(1, " ".join(words)), (1, " ".join(words[300:])), (2, " ".join(words[:300])), (3, ""), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "g long, t string")
    merged = {r.g: r.sk for r in fp.merge_sketches(fp.with_sketch(df, "t", "sk", 128), ["g"], "sk", 128).collect()}
    whole = {r.g: r.sk for r in fp.with_sketch(df, "t", "sk", 128).filter("t not like 'w300%'").collect()}
    assert merged[1] == whole[1] and merged[3] == [] and len(merged[None]) == 2
    pair = spark.createDataFrame([(merged[2], merged[1])], "a array<long>, b array<long>")
    r = pair.select(fp.containment(F.col("a"), F.col("b")).alias("c"), fp.resemblance(F.col("a"), F.col("b")).alias("r"),
                    fp.distinct_shingles(F.col("b")).alias("d")).first()
    assert r.c > 0.75 and abs(r.r - 296 / 896) < 0.15 and abs(r.d - 896) < 250
