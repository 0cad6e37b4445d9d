"""The compression classifier against plain sizes, held-out labels and odd rows."""

import zlib

import numpy as np
import zstandard

from tests.llm.cases import empty, odd_documents
from weftline.llm import zipquality

SF = "/root/testdata/sf0.1"


def plain_measure(model, text):
    raw = (text or "").encode()
    parts = [raw[i : i + zipquality.WINDOW] for i in range(0, len(raw), zipquality.WINDOW)] or [b""]
    options = {"level": zipquality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}

    def total(dictionary):
        more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        if more:
            more["dict_data"].precompute_compress(level=zipquality.LEVEL)
        c = zstandard.ZstdCompressor(**more, **options)
        return sum(len(c.compress(p)) for p in parts)

    sizes = [(total(g), total(b)) for g, b in model.pairs]
    d = sum((b - g) / (b + g) for g, b in sizes) / max(1, len(sizes))
    left = min(1.0, total(None) / len(raw)) if raw else 1.0
    x = np.array([1, 10 * d, left, left**2, np.log1p(len(raw)) / 10, 10 * d * left])
    return 1 / (1 + np.exp(-(x @ model.weights)))


def test_scores_equal_plain_sizes_and_tell_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = zipquality.fit(docs, labels)
    assert len(model.pairs) == zipquality.PAIRS
    got = zipquality.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count()
    for r in got[::97]:
        assert abs(r["score"] - plain_measure(model, r["text"])) < 1e-9
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > np.array(bad)).mean() + (g == np.array(bad)).mean() / 2 for g in good])
    assert auc > 0.99
    assert np.mean(np.array(good) < 0.3) < 0.01 and np.mean(np.array(bad) < 0.3) > 0.85
    again = zipquality.fit(docs, labels)
    assert again.pairs == model.pairs and np.allclose(again.weights, model.weights)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(k, k % 2, None, "x") for k in range(13)] + [(3, 1, 1, "y"), (None, 1, 0, "z"), (5, None, 1, "n"), (6, 7, 1, "n")], "doc_id long, quality int, toxic int, text string")
    model = zipquality.fit(docs, labels)
    rows = zipquality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r, d in zip(rows, docs.collect(), strict=True):
        assert by.setdefault(d["text"] or "", r["score"]) == r["score"]  # null as empty, copies alike
        assert r["doc_id"] == d["doc_id"] and (r["doc_id"] is not None or not r["held_out"])
    for y, share in ((labels.where("quality = 1"), 1 - 1e-6), (labels.limit(0), 0.5), (labels.where("quality = 0"), 1e-6)):
        assert {round(r["score"], 7) for r in zipquality.score(docs, zipquality.fit(docs, y)).collect()} == {round(share, 7)}
    assert zipquality.score(empty(spark), model).count() == 0
    zipquality.fit(empty(spark), labels)


def test_copies_of_a_text_do_not_crowd_out_others(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    bad = [" ".join(w + "$$$" for w in rng.choice(words, 60)) for _ in range(60)]
    texts = [*good, *bad, *[good[0]] * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60 or k >= 120)) for k in range(len(texts))], "doc_id long, quality int")
    sampled, counts = zipquality.sample_texts(docs, labels, "doc_id", "text", "quality", 1000)
    kept = {k for k in range(120) if zlib.crc32(str(k).encode()) % 5}
    assert counts == {1: len({k for k in kept if k < 60} | {0}), 0: len({k for k in kept if k >= 60})}
    assert sampled.count() == sum(counts.values())
    rows = zipquality.score(docs, zipquality.fit(docs, labels)).where("doc_id < 120").collect()
    assert all(r["predicted"] == (r["doc_id"] < 60) for r in rows)
