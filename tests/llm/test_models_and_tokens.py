import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablesight.llm import nbest, token_counts
from tablesight.llm.common import learn_rows, table
from tablesight.llm.quality import fit_quality
from tablesight.llm.queries import QUERIES, bpe_files
from tablesight.llm.toxicity import fit_toxicity, swap_identities

from llm_rows import ODD_ROWS

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, target, least", [("op7_quality_classifier", "quality", 0.9), ("op8_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, target, least):
    out = QUERIES[name](spark, SF)
    labels = table(spark, SF, "labels").select(F.col("doc_id").alias("i"), F.col(target).alias("y"))
    got = out.join(labels, F.col("doc_id") == F.col("i")).filter("held_out").toPandas()
    assert out.count() == table(spark, SF, "documents").count()
    assert (got["predicted"] == got["y"]).mean() >= least
    assert got["score"].between(0, 1).all()


def test_learn_rows(spark):
    import zlib

    rows = spark.range(200).select("id", learn_rows(F.col("id")).alias("l")).collect()
    assert all(r.l == (zlib.crc32(str(r.id).encode()) % 4 != 2) for r in rows)


@pytest.mark.parametrize("fit", [fit_quality, fit_toxicity])
def test_classifiers_odd_rows(spark, docs_of, fit):
    docs = docs_of(ODD_ROWS, extra=True)
    for labels in ([], [(1, 1, 1)], [(None, 1, 0), (3, 0, 1), (4, 1, 0), (5, None, None), (6, 1, 0), (7, 0, 1), (9, 1, 1)]):
        model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = model.score(docs).select("score").toPandas()["score"]
        assert len(got) == len(ODD_ROWS) and got.between(0, 1).all()
    assert fit(docs_of([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).score(docs_of([])).count() == 0


def test_identity_swaps_lower_false_positives(spark, docs_of):
    """A group that toxic texts name more often must not make a neutral mention toxic."""
    rnd = random.Random(9)
    words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        text = rnd.sample(words, 8) + (["muslim"] if rnd.random() < (0.9 if toxic else 0.1) else []) + (["horrid"] if toxic and rnd.random() < 0.7 else [])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = ["muslim word1 word2"]
    plain = fit_toxicity(docs, lab, swap_penalty=0.0).scorer()(probe)[0]
    fair = fit_toxicity(docs, lab, swap_penalty=10.0).scorer()
    assert fair(probe)[0] < plain - 0.1
    assert fair(["horrid word1"])[0] > 0.8
    assert abs(fair(probe)[0] - fair(["christian word1 word2"])[0]) < 0.2


def test_swap_identities():
    assert swap_identities({"a", "muslim"}) == {"a", "christian"}
    assert swap_identities({"a"}) is None


@pytest.fixture(scope="module")
def counter():
    f = bpe_files()
    return token_counts.counter(f["ranks"], f["pattern"])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'ll", "é", "😀", "中文", "12", "!", "!!", "<|endoftext|>", "<|end", "the", "ing",
                                 "\xa0", "\x85", "\x00", "²", "don"]), max_size=12).map("".join))
def test_counts_at_every_prefix(counter, text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(tok.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.prefix_counts(text).tolist() == want
    assert counter.count(text) == want[-1]


def test_token_counts_and_budgets(docs_of):
    f = bpe_files()
    tok = Tokenizer.from_file(f["tokenizer_json"])
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    docs = docs_of(ODD_ROWS, extra=True)
    whole = token_counts.count_tokens(docs, f["ranks"], f["pattern"])
    assert all(r.n_tokens == n(r.text or "") for r in whole.collect())
    stored = token_counts.count_tokens(docs, f["ranks"], f["pattern"], prefixes=True)
    p = F.col("prefix_tokens")
    for r in stored.select("text", "n_tokens", token_counts.tokens_upto(p, F.lit(7)).alias("seven"),
                           token_counts.longest_prefix(p, F.lit(3)).alias("cut")).collect():
        t = r.text or ""
        assert r.n_tokens == n(t) and r.seven == n(t[:7])
        assert n(t[:r.cut]) <= 3 and all(n(t[:i]) > 3 for i in range(r.cut + 1, min(len(t), 60) + 1))
    assert token_counts.count_tokens(docs_of([]), f["ranks"], f["pattern"]).count() == 0


@pytest.fixture(scope="module")
def lattice():
    return nbest.lattice(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="▁theingaé日\nx", min_size=1, max_size=9), st.integers(1, 6))
def test_word_nbest_against_all_segmentations(lattice, word, n):
    got, want = lattice.word_nbest(word, n), nbest.brute_nbest(lattice, word, n)
    assert [s for s, _ in got] == [s for s, _ in want]
    assert got == want
    assert all(lattice.decode(ids) == word for _, ids in got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["▁the", "▁in", "▁a", "▁日", "\n", "▁▁"]), min_size=1, max_size=4).map("".join))
def test_text_nbest_against_all_segmentations(lattice, text):
    want = nbest.brute_nbest(lattice, text, 4)
    got = lattice.nbest(text, 4)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want])


def prefix_nbest(pl, word, n):
    """The n best prefixes of every length with all their ids: no cap on ties."""
    best = [[(0.0, 0, ())]]
    for end in range(1, len(word) + 1):
        steps = [(s, (pl.edges[word[s:end]][0],), pl.edges[word[s:end]][1]) for s in range(end) if word[s:end] in pl.edges]
        best.append(sorted((loss - score, k + 1, ids + piece) for s, piece, score in steps for loss, k, ids in best[s])[:n])
    return [(-loss, ids) for loss, _, ids in best[-1]]


@pytest.mark.parametrize("char", "-#")
def test_tied_segmentations_of_rulers(lattice, char):
    for size in range(41, 80, 2):
        for n in (1, 2, 3):
            assert lattice.word_nbest(char * size, n) == prefix_nbest(lattice, char * size, n)


@pytest.mark.parametrize("text", ["▁the▁the", "▁in▁in▁a", "▁a▁the\n▁the"])
def test_tied_texts(lattice, text):
    assert lattice.nbest(text, 4) == nbest.brute_nbest(lattice, text, 4)


def test_digest_of_a_ruler(docs_of, lattice):
    path = public_tokenizers.path("piece_bpe_32k.model")
    text = "a\n" + "-" * 63
    *before, ruler = nbest._WORD.findall(lattice.normalized(text))
    assert ruler == "-" * 63
    want = sum((nbest.brute_nbest(lattice, w, 1)[0][1] for w in before), ()) + prefix_nbest(lattice, ruler, 1)[0][1]
    docs = docs_of([(1, text)])
    row = nbest.segmentation_digest(docs, path, 3).collect()[0]
    assert row.ids_crc32 == zlib.crc32(np.array(want, "<i4").tobytes()) and row.n_pieces == len(want)
    assert tuple(nbest.encode_nbest(docs, path, 3).collect()[0].segmentations[0].ids) == want


def test_nbest_odd_rows(docs_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = docs_of(ODD_ROWS, extra=True)
    out = nbest.decode_ids(nbest.encode_nbest(docs, path, 3).withColumn("best", F.col("segmentations")[0]["ids"]), "best", path).collect()
    for r in out:
        assert r.decoded == model.decode(model.encode(r.text or ""))
        scores = [s.score for s in r.segmentations]
        assert scores == sorted(scores, reverse=True) and 1 <= len(scores) <= 3
    digest = nbest.segmentation_digest(docs, path, 3).collect()
    for a, b in zip(sorted(out, key=lambda r: str(r)), sorted(digest, key=lambda r: str(r))):
        assert a.text == b.text and b.round_trip and b.n_pieces == len(a.best)
        assert b.scores == pytest.approx([s.score for s in a.segmentations])
    assert nbest.segmentation_digest(docs_of([]), path).count() == 0


def test_long_words(lattice):
    for n in (1, 3):
        word = "▁" + "thequickbrown-" * 25
        assert lattice.word_nbest(word, n) == prefix_nbest(lattice, word, n)
    word = "▁" + "thequickbrown-" * 3_000
    got = lattice.word_nbest(word, 3)
    assert all(lattice.decode(ids) == word for _, ids in got) and len(set(got)) == 3
    assert [s for s, _ in got] == sorted((sum(lattice.model.get_score(i) for i in ids) for _, ids in got), reverse=True)
    assert got[0][0] == -lattice._forward(word)[-1][0]


def test_nbest_clashing_columns(docs_of):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs_of([(1, "a b")])
    with pytest.raises(ValueError):
        nbest.encode_nbest(docs.withColumn("Segmentations", F.lit(1)), path)
    with pytest.raises(ValueError):
        nbest.segmentation_digest(docs.withColumn("scores", F.lit(1)), path)
