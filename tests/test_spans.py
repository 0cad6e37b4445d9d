"""Spans over lines against every pair, and symbol search by the stored index against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import intel, spans
from weftline.operators.symbolindex import SymbolIndex
from weftline.workspace import Workspace

SPAN = "symbol_id string, uri string, line int, char_start int, end_line int, char_end int, role string"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(250):
        line = rng.randrange(0, 900)
        end = line + rng.choice([0, 0, 0, 1, 2, 3, 7, 8, 60, 500])
        rows.append((f"s{k}", f"u{rng.randrange(3)}", line, rng.randrange(12), end, rng.randrange(1, 20), rng.choice(["definition", "reference"])))
    # nested spans with equal borders, one inside the other
    rows += [("outer", "n", 0, 0, 10, 5, "reference"), ("mid", "n", 2, 0, 8, 5, "reference"), ("in", "n", 2, 4, 8, 3, "definition"), ("word", "n", 5, 1, 5, 4, "reference"), ("bad", "n", 9, 0, 8, 5, "reference"), ("none", "n", None, 0, 8, 5, "reference")]
    asks = [(k, f"u{rng.randrange(4)}", rng.randrange(0, 1000), rng.randrange(20)) for k in range(300)]
    return rows, asks + [(1000, "n", 5, 2), (1001, "n", 5, 4), (1002, "n", 2, 3), (1003, "n", 1, 99), (1004, "n", 10, 5), (1005, "n", 10, 4), (1006, "n", 8, 3)]


def plain(rows, asks):
    out = {}
    for r, uri, line, char in asks:
        hit = [s for s in rows if s[1] == uri and s[2] is not None and (s[2], s[3]) <= (line, char) < (s[4], s[5])]
        if hit:
            out[r] = min(hit, key=lambda s: (s[4] - s[2], s[5] - s[3], s[2], s[3], s[0]))[0]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_innermost(spark, seed):
    rows, asks = made(seed)
    occ = spark.createDataFrame(rows, SPAN)
    req = spark.createDataFrame(asks, "request_id int, uri string, line int, char int")
    got = intel.at_position(occ, req)
    assert {r["request_id"]: r["symbol_id"] for r in got.collect()} == plain(rows, asks)
    want = {1000: "word", 1001: "in", 1002: "mid", 1003: "outer", 1005: "outer", 1006: "mid"}
    assert {k: v for k, v in plain(rows, asks).items() if k >= 1000} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spans.at(occ.limit(0), req).count() == 0 and spans.at(occ, req.limit(0)).count() == 0


def test_a_span_lies_in_two_bins_at_most(spark):
    rows = [(f"s{k}", "u", k % 77, 0, k % 77 + k, 1, "reference") for k in range(400)]
    cut = spans.binned(spark.createDataFrame(rows, SPAN))
    assert cut.groupBy("symbol_id").count().agg(F.max("count")).first()[0] <= 2
    assert cut.select("level").distinct().count() == 10


def test_answers_have_both_ends(spark):
    rows = [("f", "a", 0, 4, 9, 1, "definition"), ("f", "b", 3, 0, 3, 1, "reference"), ("g", "a", 2, 0, 4, 2, "definition"), ("f", "a", 3, 1, 3, 5, "reference")]
    sym = spark.createDataFrame([("f", None, "a", "f", 12, "g", "def f", None), ("g", "f", "a", "g", 5, None, "class g", None)], "symbol_id string, parent_id string, uri string, name string, kind int, type_id string, signature string, doc string")
    with Workspace(spark, "python", [], {"occurrences": spark.createDataFrame(rows, SPAN), "symbols": sym}) as w:
        assert [tuple(r) for r in w.definition("b", 3, 0).collect()] == [("a", 0, 4, 9, 1)]
        assert [tuple(r) for r in w.type_definition("a", 8, 50).collect()] == [("a", 2, 0, 4, 2)]
        assert w.hover("a", 2, 1).first()["hover"] == "class g"
        assert sorted(tuple(r) for r in w.references("a", 3, 2, False).collect()) == [("a", 3, 1, 3, 5), ("b", 3, 0, 3, 1)]
        edits = w.rename_edits("a", 3, 2, "h").withColumn("request_id", F.lit(1))
        assert [(u, len(e)) for u, e in sorted(intel.edits_by_file(edits).first()["changes"].items())] == [("a", 2), ("b", 1)]
        versions = spark.createDataFrame([("b", 7)], "uri string, version int")
        assert [(d["uri"], d["version"], d["edits"][0]["end_line"]) for d in intel.document_changes(edits, versions).first()["document_changes"]] == [("a", None, 9), ("b", 7, 3)]
        assert sorted(r["uri"] for r in intel.file_edits(edits).collect()) == ["a", "b"]


NAMES = ["getUser", "GetUsers()", "user", "us", "u", "", None, "Ünïcode", "aaa", "aaaa", "banana()", "ananas", "x()y", "日本語", "get_user_name"]


def test_index_equals_the_scan(spark, tmp_path):
    symbols = spark.createDataFrame([(f"s{k}", n, k) for k, n in enumerate(NAMES)], "symbol_id string, name string, extra int")
    index = SymbolIndex(spark, str(tmp_path / "i")).build(symbols, 8)
    queries = ["user", "USER()", "us", "u", "", "()", "aaa", "aaaa", "aaaaa", "nan", "日本", "語", "ü", "zzz", "x()", "get_u", "e", "anana"]
    for q in queries:
        want = sorted(map(repr, map(tuple, intel.workspace_symbols(symbols, q).collect())))
        assert sorted(map(repr, map(tuple, index.search(q).select(*symbols.columns).collect()))) == want, q
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(queries)] + [(99, None)], "query_id int, query string")
    got = {}
    for r in index.search_all(asked).collect():
        got.setdefault(r["query_id"], set()).add(r["symbol_id"])
    for k, q in enumerate(queries):
        want = {r["symbol_id"] for r in intel.workspace_symbols(symbols, q).collect()} if q not in ("", "()") else set()
        assert got.get(k, set()) == want, q


def test_index_reads_few_rows(spark, tmp_path):
    symbols = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("symbol_id"), F.concat(F.lit("name"), F.col("id") * 7919).alias("name"))
    index = SymbolIndex(spark, str(tmp_path / "i")).build(symbols, 16)
    found = index.candidates("9187")
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and "(bucket#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert 0 < found.count() < 600
    with Workspace(spark, "python", [], {"symbols": symbols}, symbol_index=index) as w:
        assert w.workspace_symbols("NAME9187").count() == intel.workspace_symbols(symbols, "name9187").count()


def test_copies_are_searched_once_and_expanded_in_many_tasks(spark, tmp_path, monkeypatch):
    from weftline.operators import symbolindex

    monkeypatch.setattr(symbolindex, "ROWS", 1000, raising=False)
    symbols = spark.range(300).select(F.concat(F.lit("s"), "id").alias("symbol_id"), F.when(F.col("id") % 3 == 0, "Cold Gear()").otherwise("cold gear").alias("name"))
    index = SymbolIndex(spark, str(tmp_path / "i")).build(symbols, 4)
    grams = {"cold gear"[k : k + n] for n in (1, 2, 3) for k in range(10 - n)}
    assert index._table("postings").count() == len(grams)  # of one class, not of each symbol
    asked = spark.range(60).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "COLD").otherwise("o").alias("query"))
    found = index.search_all(asked)
    assert found.distinct().count() == found.count() == 60 * 300
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 9000


def test_a_position_is_sent_once_for_spans_of_few_lines(spark):
    rows = [(f"s{k}", "u", k, 0, k + k % 64, 1, "reference") for k in range(200)]
    cut = spans.binned(spark.createDataFrame(rows, SPAN), spans.STEP)
    assert [r["level"] for r in cut.select("level").distinct().collect()] == [6]
    req = spark.createDataFrame([(1, "u", 5, 2)], "request_id int, uri string, line int, char int")
    plan = spans.innermost(spark.createDataFrame(rows, SPAN), req)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3  # spans, requests, answers: none to tell levels by file


def test_requests_are_counted_by_symbol_before_they_meet_its_references(spark):
    from tests.duck import SF
    from weftline import catalog

    plan = catalog.queries()["lq5_references_over_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") and plan.index("Join") < plan.index("Aggregate")


def test_many_queries_for_one_symbol_are_many_tasks(spark, tmp_path, monkeypatch):
    from weftline.operators import symbolindex

    monkeypatch.setattr(symbolindex, "ROWS", 100)
    monkeypatch.setattr(symbolindex, "TILE", 20, raising=False)
    index = SymbolIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame([("s1", "gear"), ("s2", "bolt"), ("s2", "bolt"), (None, "Bolt()")], "symbol_id string, name string"), 4)
    asked = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("query_id"), F.when(F.col("id") < 2000, "GEAR").otherwise("ol").alias("query"))
    found = index.search_all(asked)
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
    symbols = spark.createDataFrame([("s1", "gear", "GEAR"), ("s2", "bolt", "ol"), ("s2", "bolt", "ol"), (None, "Bolt()", "ol")], "symbol_id string, name string, query string")
    expected = asked.join(symbols, "query").select("query_id", "symbol_id", "name")  # repeated queries and symbols, and null ids, are rows
    assert found.count() == 5000 and found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
