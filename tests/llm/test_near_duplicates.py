import re

import numpy as np
import pytest

from tablesight.llm import embeddings, minhash
from tablesight.llm.common import table
from tablesight.llm.components import connected_components, unite

from llm_rows import ODD_ROWS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    g = Groups()
    for x, (i, a) in enumerate(sets):
        g.find(i)
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                g.join(i, j)
    return {i: g.find(i) for i, _ in sets}


def check(df, rows, k, num, den):
    out = minhash.near_duplicates(df, k, num, den).toPandas()
    assert len(out) == len(rows)
    want = brute_components(rows, k, num, den)
    for r in out.itertuples():
        if r.doc_id == r.doc_id and r.doc_id is not None:
            assert r.component_id == want[int(r.doc_id)], r
            assert r.kept == (int(r.doc_id) == want[int(r.doc_id)])
    return out


def test_minhash_odd_rows(docs_of):
    check(docs_of(ODD_ROWS, extra=True), ODD_ROWS, 3, 85, 100)


def test_minhash_empty(docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_minhash_families_against_brute_force(docs_of):
    """Families of edited copies whose similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = [vocab[i] for i in rng.integers(0, 3000, 120)]
        for edits in (0, 0, 1, 2, 3, 4, 5, 6, 8, 10):
            w = list(base)
            for p in rng.integers(0, 120, edits):
                w[p] = vocab[rng.integers(0, 3000)]
            rows.append((n, " ".join(w)))
            n += 1
    for k, num in ((3, 85), (5, 80)):
        check(docs_of(rows), rows, k, num, 100)


def test_minhash_threshold_is_inclusive(docs_of):
    # 3-word shingles: 17 of 20 shared is 85 %
    a = [f"a{i}" for i in range(20)]
    b = a[:19]
    sets = [shingles(" ".join(x), 3) for x in (a, b)]
    assert len(sets[0] & sets[1]) == 17 and len(sets[0] | sets[1]) == 18
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    check(docs_of(rows), rows, 3, 85, 100)


def test_minhash_fixture_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(docs, rows, 3, 85, 100)


def test_components_of_paths_stars_and_cliques(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, j) for j in range(1001, 1400)]
    edges += [(int(a), int(b)) for a, b in rng.integers(2000, 2200, (150, 2))]
    g = Groups()
    for a, b in edges:
        g.join(a, b)
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    assert {(r.node, r.component) for r in out.itertuples()} == {(x, g.find(x)) for e in edges if e[0] != e[1] for x in e}


def test_unite():
    p = unite(np.arange(6), np.array([0, 4, 2]), np.array([3, 5, 3]))
    assert p.tolist() == [0, 1, 0, 0, 4, 4]


def brute_links(rows, cosine):
    g, links = Groups(), {}
    ok = [(n, i, lab, np.array(v, float)) for n, (i, v, lab) in enumerate(rows)
          if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, i, lab, v in ok:
        links[n] = 0
        for m, j, lab2, u in ok:
            if m != n and lab == lab2 and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine:
                links[n] += 1
                g.join(i, j)
    return links, g


@pytest.mark.parametrize("chunk", [8192, 16])
def test_embeddings_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=24)
        for spread in (0, 0, 0.02, 0.05, 0.07, 0.08, 0.1, 0.3):
            rows.append((len(rows), (centre + rng.normal(size=24) * spread * np.linalg.norm(centre) / 2).astype(np.float32).tolist(), c % 3))
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, [None] * 24, 1), (504, rows[0][1], None),
             (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [], 1), (508, [float("inf")] + [1.0] * 23, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as rep", "'q' as cell")
    out = embeddings.link_embeddings(df).toPandas().set_index("vec_id")
    links, g = brute_links(rows, 0.93)
    assert len(out) == len(rows)
    for n, (i, _, _) in enumerate(rows):
        assert out.loc[i, "n_links"] == links.get(n, 0), i
        assert out.loc[i, "component_id"] == g.find(i)


def test_embeddings_empty(spark):
    assert embeddings.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_repeated_ids_and_extreme_sizes(spark):
    a, b, c = [1.0, 0.0, 0.1, 0.0], [1.0, 0.02, 0.1, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (1, c, 0), (7, [x * 1e200 for x in a], 0), (3, [x * 1e-200 for x in b], 0), (3, c, 1)]
    out = embeddings.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (1, 0, 1, True), (7, 3, 1, False), (3, 3, 1, False), (3, 0, 3, True)])
