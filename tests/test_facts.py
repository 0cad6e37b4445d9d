"""Facts that follow changes equal a rebuild, whatever comes twice, late or not at all."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftline import stages
from weftline.sources import pysymbols
from weftline.streaming import facts

TABLES = {"symbols": (pysymbols.SYMBOL, pysymbols.python_symbols), "calls": (pysymbols.CALL, pysymbols.python_calls)}
CHANGE = "uri string, seq long, deleted boolean, text string"


def rebuilt(changes):
    """(uri, name) of each file's newest text, and the files."""
    last = {}
    for uri, seq, deleted, text in changes:
        if uri not in last or seq > last[uri][0]:
            last[uri] = (seq, deleted or text is None, text)
    names = sorted((u, s[3]) for u, (_, gone, text) in last.items() if not gone and text != "broken(" for s in pysymbols.symbols_of(u, text))
    return names, sorted((u, seq, gone) for u, (seq, gone, _) in last.items())


def state(store):
    return sorted((r["uri"], r["name"]) for r in store.facts("symbols").collect()), sorted(tuple(r) for r in store.facts("files").collect())


def made(rng, n, seq):
    texts = ["def a():\n    b()\n", "class C:\n    x = 1\n    def m(self): pass\n", "", "broken(", None]
    return [(f"u{rng.randrange(12)}", next(seq), rng.random() < 0.2, rng.choice(texts)) for _ in range(n)]


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng, seq = random.Random(1), iter(range(10_000))
    store = facts.FactStore(spark, f"file://{tmp_path}/s", TABLES, 4)
    assert state(store) == ([], [])
    told = []
    for number in range(4):
        batch = made(rng, 15, seq)
        told += batch
        assert store.apply(spark.createDataFrame(batch, CHANGE), number, "log")
        assert state(store) == rebuilt(told)
    # a replay, an empty batch, a late change, a change of another source
    assert not store.apply(spark.createDataFrame(made(rng, 9, seq), CHANGE), 3, "log")
    assert store.apply(spark.createDataFrame([], CHANGE), 4, "log")
    late = [(u, -1, False, "def late(): pass\n") for u, *_ in told[:5]] + [("new", 1, False, "def new(): pass\n"), (None, 1, False, "x = 1")]
    assert store.apply(spark.createDataFrame(late, CHANGE), 5, "log")
    told.append(("new", 1, False, "def new(): pass\n"))
    assert state(store) == rebuilt(told)
    other = [("new", 5_000, True, None)]
    assert store.apply(spark.createDataFrame(other, CHANGE), 0, "other")
    assert state(store) == rebuilt(told + other)
    assert store.vacuum(1) > 0 and state(store) == rebuilt(told + other) and store.vacuum(1) == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = facts.FactStore(spark, f"file://{tmp_path}/s", TABLES, 32)
    store.apply(spark.createDataFrame([(f"u{k}", 1, False, f"x{k} = 1") for k in range(200)], CHANGE), 0)
    store.apply(spark.createDataFrame([("u7", 2, False, "y = 2")], CHANGE), 1)
    assert len([d for d in os.listdir(tmp_path / "s/symbols/v=1") if d.startswith("bucket=")]) == 1
    assert sorted(set(store.commit()["versions"].values())) == [0, 1]
    plan = store.facts("symbols")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_a_batch_that_fails_leaves_the_last_commit(spark, tmp_path):
    store = facts.FactStore(spark, f"file://{tmp_path}/s", TABLES, 4)
    store.apply(spark.createDataFrame([("a", 1, False, "x = 1")], CHANGE), 0)
    before = state(store)

    def fails(files):
        return pysymbols.python_calls(files).withColumn("line", F.raise_error(F.lit("no")).cast("int"))

    broken = facts.FactStore(spark, f"file://{tmp_path}/s", TABLES | {"calls": (pysymbols.CALL, fails)}, 4)
    change = spark.createDataFrame([("a", 2, False, "def f():\n    g()\n")], CHANGE)
    with pytest.raises(Exception, match="no"):
        broken.apply(change, 1)
    assert state(store) == before
    assert store.apply(change, 1) and state(store) == ([("a", "f")], [("a", 2, False)])
    with pytest.raises(RuntimeError):
        store._write_commit(store.commit())


def test_stream_of_real_files(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.py").write_text("def one(): pass\n")
    (tmp_path / "w/b.py").write_bytes(b"\xff\xfe")
    events = spark.createDataFrame([(1, "added", f"{tmp_path}/w/a.py"), (2, "added", f"{tmp_path}/w/b.py"), (3, "added", f"{tmp_path}/w/gone.py"), (4, "added", f"{tmp_path}/w/c.txt")], "seq long, change string, abs_path string")
    rows = facts.with_texts(events, suffixes=(".py",))
    assert sorted((r["seq"], r["text"]) for r in rows.collect()) == [(1, "def one(): pass\n"), (2, ""), (3, None)]
    rows.write.parquet(str(tmp_path / "log"))
    store = facts.FactStore(spark, f"file://{tmp_path}/s", TABLES, 4)
    for _ in range(2):  # a restart of the same stream has nothing to do
        facts.follow(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log")), store, str(tmp_path / "c"), "w").awaitTermination()
    assert [n for _, n in state(store)[0]] == ["one"] and store.commit()["number"] == 0
    assert stages.exists(spark, f"file://{tmp_path}/s/files")


def test_facade_sees_edits(spark, tmp_path):
    from weftline.workspace import Workspace

    path = tmp_path / "m.py"
    event = lambda seq, change: spark.createDataFrame([(seq, change, str(path))], "seq long, change string, abs_path string")
    sent = []
    store = facts.FactStore(spark, f"file://{tmp_path}/s", TABLES, 4)
    with Workspace(spark, "python", [".py"], {"symbols": store.facts("symbols")}, send=sent.extend, index=store) as w:
        assert w.workspace_symbols("before").count() == 0
        path.write_text("def before(): pass\n")
        w.notify_file_changes(event(1, "added"))
        assert [r["name"] for r in w.workspace_symbols("before").collect()] == ["before"]
        path.write_text("class After:\n    def m(self): pass\n")
        w.notify_file_changes(event(2, "modified"))
        assert w.workspace_symbols("before").count() == 0
        assert sorted(r["path"] for r in w.document_symbols(f"file://{path}").collect()) == ["After", "After/m"]
        path.unlink()
        w.notify_file_changes(event(3, "deleted"), 2)
        w.notify_file_changes(event(1, "added"), 2)  # told twice
        assert w.document_symbols(f"file://{path}").count() == 0
    assert [t for _, t in sent] == [1, 2, 3, 1]
