"""Fill-in-middle against a plain version."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import empty, odd_documents
from weftline.llm import infill


def plain(doc_id, text):
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_odd_documents(spark):
    more = [(k, t, "en", "s", 1, None, None, None, None) for k, t in enumerate(["<P", "<", "S>", "P><", "<M>", "😀" * 700, "a😀\x00b" * 3000, "<<P", "é", "\r\n"] * 12, 1000)]
    docs = odd_documents(spark).union(spark.createDataFrame(more, odd_documents(spark).schema))
    rows = infill.transform(docs).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows]
    assert sorted(map(repr, got)) == sorted(repr((d["doc_id"], *plain(d["doc_id"], d["text"]))) for d in docs.collect())
    assert all(r["restored"] == r["text"] for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert infill.transform(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 3, 512])
@pytest.mark.parametrize("grammar", sorted(infill.GRAMMARS))
def test_units_and_blocks_join_to_the_text(spark, grammar, size):
    texts = ["😀a🏽b  c.d. e\nf\n\n g1 22é!? x", "", "x" * 20, "\n", " \t ", "Ünï — 日本。 \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    u, b = infill.units(F.col("t"), grammar), infill.blocks(F.col("t"), grammar, size)
    for r in rows.select("t", u.alias("u"), F.flatten(F.transform(b, lambda x: infill.units(x, grammar))).alias("v")).collect():
        assert "".join(r["u"]) == r["t"] and r["u"] == r["v"] and "" not in r["u"]


def test_cuts_fall_between_units(spark):
    words = " ".join(f"w{k}" for k in range(900))
    docs = spark.createDataFrame([(k, words) for k in range(40)], "doc_id long, text string")
    for r in infill.transform(docs, grammar="word", plain_percent=0).collect():
        s = hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()
        a, b = sorted((int(s[:8], 16) % 901, int(s[8:16], 16) % 901))
        ends = [len(" ".join(f"w{i}" for i in range(k))) + (0 < k < 900) for k in (a, b)]
        assert r["n"] == 900 and [r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]] == ends
