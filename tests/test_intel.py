"""Code-structure queries on a small source, markers, configuration and the facade."""

import pytest

from weftline.functions import text
from weftline.model import SYMBOL_KINDS, WatchConfig, symbol_kinds
from weftline.operators import intel
from weftline.sources.languages import load_languages, parse_languages
from weftline.sources.pysymbols import python_calls, python_symbols
from weftline.workspace import Workspace

SOURCE = '''class Greeter:  ## MARK:cls
    """Says hello."""

    NAME = "x"

    def greet(self, who):  ## MARK:greet
        return make(who)


def make(who):  ## MARK:make
    return Greeter().greet(who)


g = make(1)  ## MARK:call
  ## MARK:alone
g.greet(2)
'''


@pytest.fixture(scope="module")
def facts(spark):
    occ = [("s1", "u1", 0, 6, 13, "definition"), ("s1", "u2", 4, 2, 9, "reference"), ("s1", "u1", 8, 0, 7, "reference"), ("s2", "u2", 4, 0, 20, "reference"), ("s2", "u2", 1, 0, 5, "definition"), ("t", "u3", 0, 0, 1, "definition")]
    sym = [("s1", None, "u1", "Greeter", 5, "t", "class Greeter", "Says hello."), ("s2", "s1", "u2", "greet", 6, None, "def greet()", None), ("t", None, "u3", "T", 5, None, "class T", None)]
    return {
        "occurrences": spark.createDataFrame(occ, "symbol_id string, uri string, line int, char_start int, char_end int, role string"),
        "symbols": spark.createDataFrame(sym, "symbol_id string, parent_id string, uri string, name string, kind int, type_id string, signature string, doc string"),
        "calls": spark.createDataFrame([("s2", "s1"), ("s1", "s2"), ("s2", "s2")], "caller_id string, callee_id string"),
    }


def test_facade_answers(spark, facts):
    with Workspace(spark, "Python", [".py"], facts) as w:
        assert w.supports("rename_provider") and not w.supports("nothing")
        # the innermost span wins
        assert [r["uri"] for r in w.definition("u2", 4, 3).collect()] == ["u1"]
        assert [r["uri"] for r in w.definition("u2", 4, 12).collect()] == ["u2"]
        assert w.definition("u2", 99, 0).count() == 0
        assert [r["uri"] for r in w.type_definition("u2", 4, 3).collect()] == ["u3"]
        assert w.references("u1", 0, 6).count() == 3 and w.references("u1", 0, 6, False).count() == 2
        assert w.hover("u1", 0, 7).first()["hover"] == "class Greeter\nSays hello."
        assert {r["name"] for r in w.outgoing_calls("u2", 1, 0).collect()} == {"Greeter", "greet"}
        assert {r["name"] for r in w.incoming_calls("u1", 0, 6).collect()} == {"greet"}
        edits = w.rename_edits("u1", 0, 6, "Hi")
        assert edits.count() == 3 and {r["new_text"] for r in edits.collect()} == {"Hi"}
        assert [r["path"] for r in w.document_symbols("u1").collect()] == ["Greeter"]
        assert w.workspace_symbols("GREET()").count() == 2 and w.workspace_symbols("zz").count() == 0
        with w.open_files("u1"):
            assert w.is_open("u1")
        assert not w.is_open("u1") and w.get_diagnostics("u1") == []
    assert not w.supports("rename_provider")
    w.close()
    with pytest.raises(RuntimeError):
        w.definition("u1", 0, 0)


def test_facade_servers_and_names(spark, facts):
    with Workspace(spark, "python", servers=[lambda: None, lambda: facts]) as w:
        assert w.supports("hover_provider")
    with pytest.raises(RuntimeError), Workspace(spark, "python", servers=[lambda: None]):
        pass
    with pytest.raises(ValueError, match="valid ids"):
        Workspace(spark, "klingon")
    with Workspace(spark, "python", facts={"symbols": facts["symbols"]}) as w:
        assert w.supports("document_symbol_provider") and not w.supports("references_provider")


def test_notify(spark):
    sent = []
    w = Workspace(spark, "python", [".py"], send=sent.append)
    rows = spark.createDataFrame([(2, "deleted", "/r/b.py"), (1, "added", "/r/a.py"), (3, "added", "/r/c.md")], "seq int, change string, abs_path string")
    w.notify_file_changes(rows)
    w.notify_file_changes(rows.where("seq = 3"))
    assert sent == [[("file:///r/a.py", 1), ("file:///r/b.py", 3)]]
    w.notify_raw([("file:///r/c.md", 1)])
    assert len(sent) == 2


def test_diagnostics(spark):
    p = spark.createDataFrame([("u", 1, ["a"]), ("u", 2, []), ("v", 1, ["b"])], "uri string, push_seq int, diagnostics array<string>")
    files = spark.createDataFrame([("u",), ("v",), ("w",)], "uri string")
    assert {r["uri"]: r["diagnostics"] for r in intel.get_diagnostics(p, files).collect()} == {"u": [], "v": ["b"], "w": []}
    p.withColumn("diagnostics", p["diagnostics"].cast("string")).createOrReplaceTempView("pushed")
    w = Workspace(spark, "python", diagnostics_table="pushed")
    assert w.get_diagnostics("v") == ["[b]"] and w.get_diagnostics("none", timeout=0.2) == []


def test_cyclic_calls_end(spark):
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "caller_id string, callee_id string")
    got = intel.reachable_calls(c, spark.createDataFrame([("a",)], "symbol_id string"), 10)
    assert {r["callee_id"]: r["hops"] for r in got.collect()} == {"b": 1, "c": 2, "a": 3}


def test_python_facts(spark):
    files = spark.createDataFrame([("u", SOURCE), ("bad", "def (")], "uri string, text string")
    rows = {r["name"]: r for r in python_symbols(files).collect()}
    assert {n: r["kind"] for n, r in rows.items()} == {"Greeter": 5, "NAME": 14, "greet": 6, "make": 12, "g": 13}
    assert rows["greet"]["parent_id"] == rows["Greeter"]["symbol_id"] and rows["Greeter"]["doc"] == "Says hello."
    assert {(r["caller_id"].split("::")[-1], r["callee"]) for r in python_calls(files).collect()} == {("greet", "make"), ("make", "greet"), ("make", "Greeter")}
    walked = intel.walk(python_symbols(files).withColumnRenamed("uri", "file"), 3)
    assert {r["path"] for r in walked.collect()} == {"Greeter", "Greeter/NAME", "Greeter/greet", "make", "g"}


def test_markers(spark):
    lines = text.source_lines(spark.createDataFrame([("u", SOURCE)], "uri string, text string"))
    got = {r["name"]: (r["line"], r["char"]) for r in text.markers(lines, "## MARK:", ["uri"]).collect()}
    assert got == {"cls": (0, 6), "greet": (5, 8), "make": (9, 4), "call": (13, 4), "alone": (14, 2)}
    after = text.find_after(lines, text.markers(lines, "## MARK:", ["uri"]), "greet", ["uri"])
    assert {r["name"]: (r["line"], r["char"]) for r in after.collect()} == {"make": (10, 21), "alone": (15, 2)}


def test_kinds(spark):
    assert len(SYMBOL_KINDS) == 26 and SYMBOL_KINDS[4] == "Class" and symbol_kinds(spark).count() == 26


def test_configuration(spark, tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[[language]]\nname = "python"\nserver = "s"\n')
    assert [tuple(r) for r in load_languages(spark, f).collect()] == [("python", [], "s", [])]
    assert parse_languages({}) == []
    for bad in ({"language": {}}, {"language": ["x"]}, {"language": [{"server": "s"}]}, {"language": [{"name": "a"}]}, {"language": [{"name": "a", "server": "s", "suffixes": "x"}]}, {"language": [{"name": "a", "server": "s", "server_args": 1}]}):
        with pytest.raises(ValueError):
            parse_languages(bad)
    with pytest.raises(FileNotFoundError):
        load_languages(spark, tmp_path / "none")


def test_defaults():
    c = WatchConfig()
    assert (c.debounce_ms, c.step_ms, c.poll_delay_ms, c.git_timeout_s, c.git_chunk_size, c.coalesce_events) == (1600, 50, 300, 10.0, 4000, True)
