import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablesight.llm import packing, sharding
from tablesight.llm.queries import bpe_files
from tablesight.llm.tokenization import encode_ids

from llm_rows import ODD_ROWS


def brute_bins(sizes, cap):
    """Fewest bins by trying all placements (tiny inputs)."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in {x for x in rooms if x >= sizes[i]}:
            k = rooms.index(r)
            go(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1:])
        go(i + 1, rooms + [cap - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bound_and_best_fit_against_optimum(sizes):
    a = np.array(sizes)
    bins, offset, free = packing.best_fit_decreasing(a, 12)
    opt = brute_bins(sizes, 12)
    assert packing.lower_bound(a, 12) <= opt <= len(free)
    for b in range(len(free)):
        own = sorted((offset[i], a[i]) for i in np.nonzero(bins == b)[0])
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at + free[b] == 12


def test_lower_bound_beats_the_sum_on_large_items():
    assert packing.lower_bound(np.array([7] * 10), 12) == 10


def test_cut_points():
    assert packing.cut_points(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut_points(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut_points(3, 4) == [(0, 3)]


def test_pack_documents_odd_rows(docs_of):
    files = bpe_files()
    tok = Tokenizer.from_file(files["tokenizer_json"])
    out = packing.pack_documents(docs_of(ODD_ROWS, extra=True), **files, capacity=64).toPandas()
    want = []
    for i, t in ODD_ROWS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.cut_points(len(ids), 64))]
    got = [(None if x != x else int(x), *r) for x, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert g["length"].sum() <= 64


def test_pack_rounds_reach_the_bound(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 3000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, length long").selectExpr("*", "0 as piece", "0L as start")
    out = packing.pack(df, 100, per_partition=300).toPandas()
    assert len(out) == 3000
    assert out.groupby("sequence_id")["length"].sum().max() <= 100
    assert out["sequence_id"].nunique() <= packing.lower_bound(sizes, 100) * 1.02 + 1


def test_pack_empty(docs_of):
    assert packing.pack_documents(docs_of([]), **bpe_files()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40))
def test_fast_ids_equal_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if text else []
    f = bpe_files()
    assert encode_ids(text, path, f["ranks"], f["pattern"]).tolist() == want


def test_sharding_odd_rows(docs_of):
    out = sharding.shard_documents(docs_of(ODD_ROWS, extra=False), shards=8).toPandas()
    assert len(out) == len(ODD_ROWS)
    assert sorted(out["size"]) == sorted(len((t or "").encode()) + 1 for _, t in ODD_ROWS)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert out["shard"].between(0, 7).all()


def test_sharding_balance_and_copies(spark, docs_of):
    rng = np.random.default_rng(1)
    rows = [(i, f"{i} " * int(rng.integers(1, 40))) for i in range(4000)] + [(5000 + i, "copy of one text " * 3) for i in range(800)]
    out = sharding.shard_documents(docs_of(rows), shards=8).toPandas()
    assert out[out["doc_id"] >= 5000]["shard"].nunique() == 1
    total = out.groupby("shard")["size"].sum()
    hot = out[out["doc_id"] >= 5000]["size"].sum()
    assert len(total) == 8
    assert total.max() <= max(1.02 * total.sum() / 8, hot * 1.5)


def test_sharding_empty(docs_of):
    assert sharding.shard_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_sharding_few_rows(docs_of, n):
    assert sharding.shard_documents(docs_of([(i, "t") for i in range(n)])).count() == n
