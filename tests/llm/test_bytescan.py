"""Hashes of spans and tables of chunks, on words that collide under polynomial hashes modulo a power of two."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest

from weftline.llm import bytescan, packing, piecebpe, quality, shinglejoin, wordbpe

SIZES = (512, 1024, 2048, 4096, 8192)


def twins(n):
    """Words by the parity of the bits of each place, and with the letters swapped."""
    odd = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[k] for k in odd), "".join("ba"[k] for k in odd)


@pytest.mark.parametrize("n", SIZES)
def test_twins_hash_apart(n):
    one, two = (np.frombuffer(t.encode(), np.uint8) for t in twins(n))
    both = np.concatenate([one, two])
    hashes = bytescan.span_hashes(both, np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] != hashes[1]
    assert bytescan.span_hashes(one, np.array([0]), np.array([n]))[0] == hashes[0]


def test_hash_depends_on_the_span_alone():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) for _ in range(4000)]
    seen = {}
    for block in (1, 64, 1 << 17):
        buf = np.frombuffer(b" ".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        starts = np.cumsum(sizes + 1) - sizes - 1
        for w, h in zip(words, bytescan.span_hashes(buf, starts, starts + sizes, block).tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_table_compares_bytes_when_hashes_agree():
    solved = []

    def solve(chunks):
        solved.extend(chunks)
        return np.array([b for c in chunks for b in c[::-1]], np.int64), np.array([len(c) for c in chunks])

    table = bytescan.ChunkTable(solve, np.int64, room=50, size=200)
    rng = np.random.default_rng(1)
    for _ in range(60):
        words = [bytes(rng.integers(97, 100, rng.integers(1, 20)).astype(np.uint8)) for _ in range(40)]
        buf = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        hashes = rng.integers(0, 2, 40).astype(np.uint64) + np.array([len(w) for w in words], np.uint64) // np.uint64(4)  # nearly all collide
        values, cuts = table.lookup(hashes, buf, ends - [len(w) for w in words], ends)
        assert [bytes(values[a:b].astype(np.uint8)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [w[::-1] for w in words]


def test_tokenizers_agree_with_the_libraries_on_twins():
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    texts = [t for n in SIZES for t in twins(n)] + [" ".join(twins(2048))]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, cuts = wordbpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")).encode_slice(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = [b" " + t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, cuts = piecebpe.PieceBpe(path).encode_slice(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k, t in enumerate(texts):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == library.encode(t)


def test_operators_on_twins(spark):
    import sentencepiece

    texts = [t for n in SIZES for t in twins(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    joined = shinglejoin.jaccard_classes(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in joined} == {(k, k) for k in range(len(texts))}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in piecebpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect():
        ids = ",".join(map(str, library.encode(texts[r["doc_id"]])))
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct().count() == len(texts)
    lines = spark.createDataFrame([(n, "\n".join(twins(n))) for n in SIZES], "doc_id long, text string").selectExpr("*", "'s' AS source")
    assert {r["n_dup_lines"] for r in quality.judge(lines).collect()} == {0}
