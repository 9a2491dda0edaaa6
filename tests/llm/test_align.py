"""The alignment of two tokenizers against plain Python over the vocabularies' own libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import align
from skyloom.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, n_a long, pairs string, row string, n long"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, "The quick brown fox."), (2, "The quick brown fox."), (3, None), (4, ""), (5, " "), (6, "\n\n  a\tb "), (7, "a▁b"),
    (8, "<|endoftext|> <s> </s> <unk> <0x41> <|startoftext|>"), (9, "Ünï ça 東京 😀😀 ελ"), (10, "x" * 5000), (11, "the quick brown the the dog" * 200), (None, "no id"), (12, "a\x00b\x0cc\r\n"),
    (13, "東京都 " * 500), (14, "!!!???" * 300), (15, "  leading"), (16, "é́ ﬁ ①"),
]


def naive(texts):
    """Rows by the JSON tokenizer and the piece model, with ends kept in sets."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=public_tokenizers.path(align.PIECES))
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    rows, links = [], []
    for i, t in texts:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        spell_a = [bytes(byte_of[c] for c in tok.id_to_token(x)) for x in a]
        spell_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or not b"".join(spell_a) == b"".join(spell_b) == (" " + t).encode():
            rows.append((i, 0, 0, 0, 0, ""))
            links.append([])
            continue
        end_a, end_b = np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()
        common = sorted(set(end_a) & set(end_b))
        groups, low = [], 0
        for c in common:
            groups.append(",".join(str(x) for x, e in zip(a, end_a, strict=True) if low < e <= c) + "|" + ",".join(str(x) for x, e in zip(b, end_b, strict=True) if low < e <= c))
            low = c
        own = [(x, y) for x, e in zip(a, end_a, strict=True) if e in set(common) for y, f in zip(b, end_b, strict=True) if f == e] if len(a) < 50 else [(a[end_a.index(c)], b[end_b.index(c)]) for c in common]
        links.append(own)
        rows.append((i, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for own in links for x in own)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((*r[:5], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), r[5]) for r, own in zip(rows, links, strict=True)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "p", "r", 9) for i, t in rows], SCHEMA)


def rows_of(spark, docs, most=None):
    from pyspark.sql import functions as F

    texts = cut(align.aligned(docs).withColumn("row", F.monotonically_increasing_id()), "t")
    counts = align.with_best(cut(align.pair_counts(texts), "c"), len(align.piece_side(align.piece_file())[1]))
    return sorted((tuple(r) for r in align.measured(texts, counts, most).collect()), key=str)


@pytest.mark.parametrize("most", [None, 0])
def test_equals_the_libraries(spark, monkeypatch, most):
    if most == 0:
        monkeypatch.setattr(align, "MOST_HELD", 3)
        monkeypatch.setattr(align, "SLICE_BYTES", 100)
    got = rows_of(spark, table(spark, TEXTS), most)
    assert got == naive(TEXTS)
    assert sum(r[1] > 0 for r in got) >= 14


@pytest.mark.parametrize("most", [None, 0])
def test_no_rows_and_no_texts(spark, most):
    assert rows_of(spark, table(spark, []).where("false"), most) == []
    assert rows_of(spark, table(spark, [(1, None), (2, "")]), most) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_on_all_documents(spark, sf):
    got = align.op12_alignment(spark, sf)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == naive(docs)


def test_common_ends_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ends_a, ends_b, last, total = [], [], [], 0
        for _text in range(rng.integers(1, 5)):
            length = int(rng.integers(1, 60))
            inner = np.arange(1, length)
            a, b = (total + np.r_[inner[rng.random(len(inner)) < rng.random()], length] for _ in range(2))
            ends_a, ends_b, total = [*ends_a, *a.tolist()], [*ends_b, *b.tolist()], total + length
            last.append(len(ends_a) - 1)
        got = align.common_ends(np.asarray(ends_a), np.asarray(ends_b), np.asarray(last))
        assert got.tolist() == [e in set(ends_b) for e in ends_a]


def test_ties_for_the_highest_count(spark):
    counts = spark.createDataFrame([(0 * 10 + 3, 5), (1 * 10 + 3, 5), (2 * 10 + 3, 4), (2 * 10 + 4, 1)], "pair long, n long")
    assert {r.pair for r in align.with_best(counts, 10).collect() if r.best} == {3, 13, 24}
