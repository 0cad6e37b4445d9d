"""Packing, token counts and SentencePiece against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty, odd_documents
from weftline.llm import packing, piecebpe, tokencount
from weftline.llm.wordbpe import WordBpe

WORD, PIECE, RANKS = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001/documents.parquet"


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 10_000])
def test_decompose(n):
    parts = packing.decompose(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 4096 for p in parts) and parts == sorted(parts, reverse=True)
    assert len(set(p for p in parts if p < 4096)) == len([p for p in parts if p < 4096])


def check_packing(docs):
    full = WordBpe(WORD).full
    got = packing.pack(docs, WORD, with_ids=True).collect()
    want = sorted((tuple([*full.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect()), key=repr)
    by: dict = {}
    assert len({r["sequence_id"] for r in got}) == len(got)
    whole, now = [], []
    for r in got:  # pieces of a document follow each other
        if r["start"] == 0 and now:
            whole.append(tuple(now))
            now = []
        assert r["start"] == len(now) and r["offset"] == 0 and r["length"] == len(r["ids"]) == 1 << r["bucket"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        now += r["ids"]
        by.setdefault(r["doc_tokens"], 0)
    if now:
        whole.append(tuple(now))
    assert sorted(whole, key=repr) == want and {len(w) for w in want} == set(by)


def test_packing_equals_library(spark):
    check_packing(odd_documents(spark).coalesce(1))
    check_packing(spark.read.parquet(SF).coalesce(1))
    assert packing.pack(empty(spark), WORD).count() == 0


def test_batches_hold_one_length(spark):
    rows = packing.pack(spark.read.parquet(SF).repartition(3), WORD).collect()
    batches: dict = {}
    for r in rows:
        batches.setdefault(r["batch_id"], []).append(r)
    full = 0
    for held in batches.values():
        size = held[0]["length"]
        assert {r["length"] for r in held} == {size} and sorted(r["batch_row"] for r in held) == list(range(len(held))) and len(held) * size <= 4096
        full += len(held) * size == 4096
    assert full and len(batches) - full <= 3 * 12  # a task leaves one short batch a bucket


def test_packing_chunk_cases(spark):
    texts = ["don't 's 'tis é!É́ x́ a≮ «h» 12ab34!? <|ENDOFTEXT|> a b ×÷ İstanbul Σς ①²", "x<|endoftext|>y", "a'b''s !'s ’s", "\x00a\x1cb", "naïve ﬁ ſ ŉ", "日本語text!日本"]
    check_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))


def test_pieces_equal_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["x▁y ▁a  b\n\n d▁▁", "  lead", "▁lead", " ", "é 日本 🎉", "<s> </s> <0x0A>", "²."])], "doc_id long, text string")
    docs = odd_documents(spark).select("doc_id", "text").union(more).union(spark.read.parquet(SF).select("doc_id", "text"))
    got = piecebpe.encode(docs, PIECE, with_ids=True).collect()
    texts = docs.collect()
    assert len(got) == len(texts)
    for r, d in zip(got, texts, strict=True):
        ids = sp.encode(d["text"] or "")
        decoded = sp.decode(ids)
        assert r["doc_id"] == d["doc_id"] and list(r["ids"]) == ids and r["decoded"] == decoded and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert piecebpe.encode(empty(spark), PIECE).count() == 0


def test_decode_of_any_ids():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), piecebpe.PieceBpe(PIECE)
    for ids in ([], [300], [3 + 0xC3], [3 + 0xE2, 3 + 0x96, 300], [0, 5, 300], [1, 300, 2, 301], [3 + 0x41, 3 + 0xFF, 259], [259, 259, 300]):
        assert own.decode(ids) == sp.decode(ids)


def plain_counts(text, rule):
    """Tokens by the library with their bytes' characters, attributed one by one."""
    coder = tokencount.RankBpe(RANKS, P.PATTERN).coder
    raw, owner = text.encode(), []
    for k, c in enumerate(text):
        owner += [k] * len(c.encode())
    section, s = [], 0
    for c in text:
        section.append(s)
        s += c == "\n"
    n = section[-1] + 1
    counts, crossing, at = [0.0] * n, [0] * n, 0
    for t in coder.encode_ordinary(text):
        size = len(coder.decode_single_token_bytes(t))
        chars = sorted(set(owner[at : at + size]))
        at += size
        inside = [section[c] for c in chars]
        if len(set(inside)) > 1:
            for s in set(inside):
                crossing[s] += 1
        if rule == "split":
            for s in inside:
                counts[s] += 1 / len(inside)
        else:
            counts[{"first": inside[0], "last": inside[-1], "most": max(sorted(set(inside)), key=inside.count)}[rule]] += 1
    assert at == len(raw)
    return counts, crossing


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts(spark, rule):
    docs = odd_documents(spark).select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(50, "ab\n\n\n\ncd\n\n"), (51, "é\n日\n\n🎉\n"), (52, "}\n\n  return\n")], "doc_id long, text string"))
    got: dict = {}
    for r in tokencount.count_tokens(docs, RANKS, P.PATTERN, rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r
    for d in docs.collect():
        if not d["text"]:
            assert [tuple(r)[1:] for r in got[d["doc_id"]].values()] == [(0, 0, 0, 0.0, 0, 0)]
            continue
        counts, crossing = plain_counts(d["text"], rule)
        rows = [got[d["doc_id"]][k] for k in range(len(got[d["doc_id"]]))]
        assert np.allclose([r["n_tokens"] for r in rows], counts) and [r["n_crossing"] for r in rows] == crossing
        assert abs(sum(counts) - rows[0]["doc_tokens"]) < 1e-6 and sum(r["length"] for r in rows) == len(d["text"])


def test_token_counts_edges(spark):
    assert tokencount.count_tokens(empty(spark), RANKS, P.PATTERN).count() == 0
    assert tokencount.count_tokens(odd_documents(spark), RANKS, P.PATTERN).where(F.col("doc_id").isNull()).count() == 2


def test_field_counts(spark):
    """Fields of one document, empty and null ones included, against the tokens of the whole looked at one by one."""
    rows = [(1, "A title", "Some text,\nand more.", "x"), (2, None, "only text", ""), (3, "", "", None), (4, "日本", "é🎉", "ß"), (None, "t", "u", "v"), (1, "A title", "Some text,\nand more.", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, field string")
    got = tokencount.count_field_tokens(docs, ["title", "body", "field"], RANKS, P.PATTERN, rule="first").collect()
    coder, want = tokencount.RankBpe(RANKS, P.PATTERN).coder, []
    for i, *fields in rows:
        parts = [(f or "") + ("\n" if k < 2 else "") for k, f in enumerate(fields)]
        owner = [k for k, p in enumerate(parts) for _ in p.encode()]
        counts, at, whole = [0, 0, 0], 0, "".join(parts)
        for t in coder.encode_ordinary(whole):
            counts[owner[at]] += 1
            at += len(coder.decode_single_token_bytes(t))
        want += [(i, n, float(c), len(p), sum(counts)) for n, c, p in zip(("title", "body", "field"), counts, parts, strict=True)]
    assert sorted(((r["doc_id"], r["field"], r["n_tokens"], r["length"], r["doc_tokens"]) for r in got), key=repr) == sorted(want, key=repr)


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        tokencount.count_tokens(empty(spark), RANKS, P.PATTERN, rule="none")
