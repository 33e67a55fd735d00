"""Cross-tokenizer alignment against the libraries and plain set arithmetic."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablesight.llm.alignment import align_documents, alignment_digest, cross_tokenizer, link_counts, shared_ends
from tablesight.llm.common import table
from tablesight.llm.queries import QUERIES, bpe_files

from llm_rows import ODD_ROWS

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
FILES = {**bpe_files(), "model_file": MODEL}
MORE = [(20, "a ▁ literal mark"), (21, "<s> <unk> <0x41> </s> <|endoftext|>"), (22, " lead and  double\n\nlines\nmore\t\ttabs "), (23, "\x00\x01"),
        (24, "naïve ½ ² ١٢٣ ﬁ ﷺ é"), (25, "\n"), (26, "=" * 700 + " " * 90 + "-" * 333), (27, "a\r\nb"), (28, "日本語" * 50)]


def byte_decoder():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    tok = Tokenizer.from_file(FILES["tokenizer_json"])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    back = byte_decoder()
    out, links = [], []
    for doc_id, text in rows:
        text = text or ""
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        raw_a = [bytes(back[c] for c in tok.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        parts, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = [], []
            while i < len(a) and ends_a[i] <= cut:
                x.append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                y.append(b[j])
                j += 1
            parts.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        out.append((doc_id, len(a), len(b), len(parts), hashlib.sha256(";".join(parts).encode()).hexdigest()))
        start_b = [0, *ends_b]
        mine, j = [], 0
        for i, end in enumerate(ends_a):
            start = end - len(raw_a[i])
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and start_b[k] < end:
                mine.append((a[i], b[k]))
                k += 1
        links.append(mine)
    held = Counter(p for mine in links for p in set(mine))
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(d, na, nb, ng, len(m), sum(held[p] == top[p[0]] for p in m), sum(held[p] for p in m), sha)
            for (d, na, nb, ng, sha), m in zip(out, links)], held


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), min_size=1, max_size=6))
def test_shared_ends(docs):
    a, b, low, high, base = [], [], [], [], 0
    for x, y in docs:
        last = max(x | y | {1})
        low.append(len(a))
        a += [base + v for v in sorted(x | {last})]
        b += [base + v for v in sorted(y | {last})]
        high.append(len(a) - 1)
        base += last
    a, b = np.array(a), np.array(b)
    got = shared_ends(a, b, np.array(low), np.array(high))
    inner = {i for s, e in zip(low, high) for i in range(s, e)}
    assert got.tolist() == [i for i in sorted(inner) if a[i] in set(b.tolist())]


def test_digest_equals_brute_force(spark, docs_of):
    rows = ODD_ROWS + MORE
    docs = docs_of(rows, extra=True).withColumnRenamed("a", "keys").selectExpr("*", "1 as bundle", "'p' as place")
    expected, held = brute(rows)
    assert order(map(tuple, alignment_digest(docs, **FILES).collect())) == order(expected)
    assert {(r.a_id, r.b_id): r.n_docs for r in link_counts(docs, **FILES).collect()} == dict(held)


def test_string_ids_and_empty_table(spark, docs_of):
    docs = docs_of([(1, "one text"), (None, "two texts")]).selectExpr("concat('d', doc_id) as doc_id", "text")
    got = alignment_digest(docs, **FILES)
    assert dict(got.dtypes)["doc_id"] == "string" and {r.doc_id for r in got.collect()} == {"d1", None}
    assert alignment_digest(docs_of([]), **FILES).count() == 0 and align_documents(docs_of([]), **FILES).count() == 0


def test_small_bundles(spark, docs_of, monkeypatch):
    """Pairs of a document may be counted by many bundles; the counts are of all documents."""
    from tablesight.llm import alignment

    monkeypatch.setattr(alignment, "BLOCK", 40)
    ct = cross_tokenizer(**FILES)
    texts = [t or "" for _, t in ODD_ROWS + MORE]
    cut = [x for i, j in alignment._blocks(texts) for x in ct.align(texts[i:j])]
    whole = ct.align(texts)
    assert all(np.array_equal(p, q) for x, y in zip(cut, whole) for p, q in zip(x, y))


def test_memo_holds_few_characters():
    """Words of any length: what a worker keeps is bounded by their characters."""
    from tablesight.llm import alignment

    ct = alignment.CrossTokenizer(**FILES)
    for k in range(8):
        text = " ".join(f"{k}x{i}" * 500 for i in range(60))
        (x,) = ct.align([text])
        assert len(x.b_ids) and b"".join(ct.b_bytes[i] for i in x.b_ids) == b" " + text.encode()
        assert sum(map(len, ct._words)) <= alignment.MEMO


def test_many_documents_without_tokens(spark):
    """Documents without pairs close a bundle too, and a bundle's pairs are short values."""
    from tablesight.llm import alignment

    docs = spark.range(10_500).selectExpr("id as doc_id", "if(id = 7, 'some text here', '') as text").coalesce(1)
    bundles = alignment._bundles(docs, tuple(FILES[k] for k in ("tokenizer_json", "ranks", "pattern", "model_file")), "text", "doc_id")
    kinds = dict(bundles.dtypes)
    assert bundles.count() == 2 and kinds["place"] == kinds["times"] == "binary"
    got = alignment_digest(docs, **FILES).filter("n_a > 0 or n_links > 0 or groups_sha256 <> ''").collect()
    assert list(map(tuple, got)) == [r for r in brute([(7, "some text here")])[0]]


def test_packed_numbers():
    from tablesight.llm.alignment import _packed, _unpacked

    for x in ([], [0], [5, 5, 2, 900, 0], [2**31 - 1, 0, 2**31 - 1]):
        assert _unpacked(_packed(np.array(x, np.int64))).tolist() == x


def test_documents_with_groups(spark, docs_of):
    rows = ODD_ROWS + MORE
    got = align_documents(docs_of(rows), **FILES).collect()
    for r in got:
        assert len(r.a_upto) == len(r.b_upto) and (r.a_upto[-1:] or [0]) == [len(r.a_ids)] and (r.b_upto[-1:] or [0]) == [len(r.b_ids)]
    with pytest.raises(ValueError):
        align_documents(docs_of(rows).selectExpr("*", "1 as A_IDS"), **FILES)


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op11_cross_tokenizer_alignment"](spark, SF)
    assert order(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == order(brute(rows)[0])
