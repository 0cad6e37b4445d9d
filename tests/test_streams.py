"""Snapshots, the workspace source, the watch query and the command line."""

import threading
import time

import pytest

from weftline.__main__ import banner, main, startup
from weftline.model import WatchConfig
from weftline.sources.snapshots import WorkspaceReader, WorkspaceSource, diff, snapshot
from weftline.sources.truth import of_source, symbol_tree, whole_texts
from weftline.streaming.diagnostics import latest_stream, wait_for
from weftline.streaming.watch import change_rows, console, notify, prepare, watch


def test_diff(spark):
    kind = "path string, mtime long, size long"
    a = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1), ("/c", 1, 1)], kind)
    b = spark.createDataFrame([("/b", 2, 1), ("/c", 1, 1), ("/d", 1, 1)], kind)
    assert sorted(tuple(r) for r in diff(a, b).collect()) == [("added", "/d"), ("deleted", "/a"), ("modified", "/b")]


def test_snapshot(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.txt").write_text("abc\n")
    assert [(r["path"], r["size"]) for r in snapshot(spark, str(tmp_path)).collect()] == [(str(tmp_path / "x" / "f.txt"), 4)]
    assert whole_texts(spark, str(tmp_path)).first()["text"] == "abc\n"


def test_watch_query(spark, tmp_path, capsys):
    root = tmp_path / "ws"
    root.mkdir()
    (root / "old.py").write_text("1")
    spark.dataSource.register(WorkspaceSource)
    stream = spark.readStream.format("workspace").options(roots=str(root)).load()
    got, sent = [], []

    def sink(envelope, number):
        row = envelope.first()
        notify(sent.append, [".py"])(envelope, number)
        console(envelope, number)
        got.append(row)

    q = watch(stream, [(str(root), "ws")], WatchConfig(gitignore_filter=False, repo_custom_ignores={str(root): ("*.tmp",)}), sink, str(tmp_path / "c"))
    try:
        time.sleep(4)
        (root / "new.py").write_text("2")
        (root / "skip.tmp").write_text("2")
        (root / "old.py").unlink()
        end = time.time() + 120
        while time.time() < end and sum(len(b["events"]) for b in got) < 2:
            time.sleep(0.3)
    finally:
        q.stop()
    assert {(e["rel_path"], e["change"]) for b in got for e in b["events"]} == {("new.py", "added"), ("old.py", "deleted")}
    assert sum(b["raw"] for b in got) == 2 and sum(b["filtered"] for b in got) == 2
    assert {k for rows in sent for _, k in rows} == {1, 3}
    assert "of 2 changes at" in capsys.readouterr().out or len(got) > 1


def test_a_batch_closes_after_a_quiet_period(tmp_path):
    reader = WorkspaceReader({"roots": str(tmp_path), "stepMs": "100", "debounceMs": "5000"})
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == []
    (tmp_path / "sub").mkdir()
    (tmp_path / "temp").write_text("1")

    def later():
        time.sleep(0.05)
        (tmp_path / "temp").unlink()
        (tmp_path / "kept").write_text("1")

    thread = threading.Thread(target=later)
    thread.start()
    rows, end = reader.read(start)
    thread.join()
    assert sorted(r[:4] for r in rows) == [("added", str(tmp_path / "kept"), True, False), ("added", str(tmp_path / "sub"), True, True), ("added", str(tmp_path / "temp"), False, False), ("deleted", str(tmp_path / "temp"), False, False)]
    # a restart tells what its listings differ in
    assert [r[1] for r in reader.readBetweenOffsets(start, end)] == [str(tmp_path / "kept"), str(tmp_path / "sub")]
    (tmp_path / "sub").rmdir()
    assert list(reader.read(end)[0]) == [("deleted", str(tmp_path / "sub"), False, True, 0)]


def test_added_and_deleted_in_one_batch_is_decided_by_what_exists(spark):
    kind = "change string, path string"
    cfg = WatchConfig(gitignore_filter=False)
    for rows, final in (([("added", "/w/t"), ("deleted", "/w/t")], "deleted"), ([("deleted", "/w/t"), ("added", "/w/t")], "modified")):
        frame = spark.createDataFrame(rows, kind).coalesce(1)
        assert [r["change"] for r in prepare(change_rows(frame), [("/w", "w")], cfg)[0].collect()] == [final]
    told = spark.createDataFrame([("deleted", "/w/t", True, False), ("added", "/w/t", True, False)], kind + ", exists_now boolean, is_dir boolean")
    assert prepare(change_rows(told), [("/w", "w")], cfg)[0].first()["change"] == "modified"


def test_snapshot_with_folders(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "f").write_text("a")
    got = {r["path"]: r["size"] for r in snapshot(spark, str(tmp_path), folders=True).collect()}
    assert got == {str(tmp_path / "x" / "y" / "f"): 1, str(tmp_path / "x" / "y"): None, str(tmp_path / "x"): None}


def test_wait_for(spark):
    spark.createDataFrame([("it's", 3, "a"), ("it's", 5, "b")], "uri string, push_seq long, diagnostics string").createOrReplaceTempView("pushed")
    assert wait_for(spark, "pushed", "it's") == ["b"]
    assert wait_for(spark, "pushed", "it's", 5.0, 4) == ["b"]
    began = time.monotonic()
    assert wait_for(spark, "pushed", "it's", 0.3, 5) == ["b"] and time.monotonic() - began >= 0.3
    assert wait_for(spark, "pushed", "none", 0.1) == []


def test_deep_trees(spark):
    from weftline.operators import intel

    kind = "symbol_id string, parent_id string, name string"
    chain = spark.createDataFrame([(f"s{k}", f"s{k - 1}" if k else None, f"n{k}") for k in range(12)], kind)
    got = intel.walk(chain).collect()
    assert len(got) == 12 and max(r["level"] for r in got) == 11
    loop = spark.createDataFrame([("a", None, "a"), ("b", "a", "b"), ("a", "b", "a")], kind)
    with pytest.raises(ValueError):
        intel.walk(loop)


def test_latest_diagnostics_stream(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, "[1]"), ("u", 3, "[]"), ("u", 2, "[2]"), ("v", 1, "[9]")], "uri string, push_seq long, diagnostics string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = latest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("latest").collect()) == [("u", 3, "[]"), ("v", 1, "[9]")]


def test_truth_tree(spark):
    from pyspark.sql import functions as F

    doc = '{"schema_version":3,"symbols":[{"name":"A","kind_category":"Class","children":[{"name":"b","kind_category":"Method","children":[]}]}]}'
    t = spark.createDataFrame([("m_tests_gt_x.json", doc)], "file string, d string").select("file", F.parse_json("d").alias("doc"))
    assert {(r["level"], r["path"], r["kind_category"]) for r in symbol_tree(of_source(t, "m", "x")).collect()} == {(0, "A", "Class"), (1, "A/b", "Method")}
    deep = '{"name":"z","children":[]}'
    for _ in range(11):
        deep = '{"name":"z","children":[' + deep + "]}"
    d = spark.createDataFrame([("m", '{"symbols":[' + deep + "]}")], "file string, d string").select("file", F.parse_json("d").alias("doc"))
    assert symbol_tree(d).count() == 12


def test_command_line(tmp_path, capsys):
    assert main([str(tmp_path / "none")]) == 2
    assert "not a directory" in capsys.readouterr().err
    (tmp_path / "a" / "b").mkdir(parents=True)
    cfg = WatchConfig()
    roots, nested, rules, status = startup([str(tmp_path / "a"), str(tmp_path / "a" / "b"), str(tmp_path / "a")], cfg)
    assert [label for _, label in roots] == ["a", "b"] and len(nested) == 1
    assert any("lies within" in line for line in banner(roots, nested, rules, status, cfg))
