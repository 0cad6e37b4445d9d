"""Coalescing, batches in time, envelopes and translation on hand-made rows."""

import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import changes
from weftline.streaming.watch import capped_batches_stream

EVENT = "batch int, seq long, change string, abs_path string, repo_root string, repo_label string, rel_path string, exists_now boolean"


def event(batch, seq, change, path, exists=True, root="/r"):
    return batch, seq, change, f"/r/{path}", root, "r" if root else "?", path, exists


def final(kinds: set, exists: bool) -> str:
    """The truth table, row by row."""
    if "deleted" in kinds and "added" not in kinds:
        return "deleted"
    if "added" in kinds and "deleted" not in kinds:
        return "added"
    if {"added", "deleted"} <= kinds:
        return "modified" if exists else "deleted"
    return "modified"


def test_truth_table(spark):
    rows, want = [], {}
    seq = itertools.count()
    for n, kinds in enumerate(k for r in (1, 2, 3) for k in itertools.combinations(("added", "modified", "deleted"), r)):
        for exists in (True, False):
            path = f"f{n}{exists}"
            rows += [event(0, next(seq), k, path, exists) for k in kinds]
            want[path] = final(set(kinds), exists)
    got = changes.coalesce(spark.createDataFrame(rows, EVENT), ["batch"]).collect()
    assert {r["rel_path"]: r["change"] for r in got} == want and len(got) == 14


def test_coalesce_keeps_first_order_last_label_and_null_roots(spark):
    rows = [event(0, 1, "modified", "b"), event(0, 2, "added", "a"), event(0, 3, "modified", "b"), event(0, 4, "added", "x", False, root=None), event(0, 5, "deleted", "x", False, root=None)]
    rows[2] = (*rows[2][:5], "later", *rows[2][6:])
    got = changes.coalesce(spark.createDataFrame(rows, EVENT), ["batch"]).orderBy("seq").collect()
    assert [(r["seq"], r["rel_path"], r["change"]) for r in got] == [(1, "b", "modified"), (2, "a", "added"), (4, "x", "deleted")]
    assert got[0]["repo_label"] == "later"


def test_headers_and_envelopes_keep_empty_batches(spark):
    raw = spark.createDataFrame([event(0, 1, "added", "a"), event(1, 2, "added", "b")], EVENT)
    kept = changes.coalesce(raw.where("batch = 0"), ["batch"])
    head = changes.headers(raw, kept, ["batch"])
    env = changes.envelopes(head, kept, ["batch"]).orderBy("batch").collect()
    assert [(r["raw"], r["filtered"], len(r["events"]), r["warnings"]) for r in env] == [(1, 1, 1, []), (1, 0, 0, [])]


@given(st.lists(st.integers(0, 60), max_size=40).map(sorted), st.integers(0, 12), st.integers(1, 20))
def test_capped_starts_rules(times, gap, cap):
    starts = changes.capped_starts(times, gap, cap)
    for k, (t, s) in enumerate(zip(times, starts, strict=True)):
        assert s <= t and (t - s < cap or s == t)
        if k and starts[k - 1] == s:
            assert t - times[k - 1] <= gap
        elif k:
            assert s == t and (t - times[k - 1] > gap or t - starts[k - 1] >= cap)


def test_capped_batches_in_table_and_stream(spark, tmp_path):
    rows = [(k, key, t) for k, (key, t) in enumerate((key, t) for key in ("a", "b") for t in [*range(0, 60, 3), 100, 101, 102, 150])]
    log = spark.createDataFrame(rows, "event_id long, key string, us long")
    want = {r[0]: s for key in ("a", "b") for own in [[r for r in rows if r[1] == key]] for r, s in zip(own, changes.capped_starts([r[2] for r in own], 5, 20), strict=True)}
    assert {r["event_id"]: r["batch_start"] for r in changes.capped_batches(log, "key", "us", "event_id", 5, 20).collect()} == want
    # floor buckets of a session would differ here
    assert {want[r[0]] for r in rows} != {r[2] // 20 * 20 for r in rows}
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = capped_batches_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), "key", "us", "event_id", 5, 20)
    q = stream.writeStream.format("memory").queryName("capped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["batch_start"] for r in spark.table("capped").collect()} == want


def test_suffixes(spark):
    rows = spark.createDataFrame([event(0, 1, "added", "a.py"), event(0, 2, "added", "b.PY"), event(0, 3, "added", "c.md")], EVENT)
    names = lambda df: sorted(r["rel_path"] for r in df.collect())
    assert names(changes.by_suffix(rows, [])) == ["a.py", "b.PY", "c.md"]
    assert names(changes.by_suffix(rows, [".py"])) == ["a.py"]
    assert names(changes.by_suffix(rows, [".py", "md"])) == ["a.py", "c.md"]
    assert names(changes.by_suffix(rows, [".x"])) == []


def test_translate_and_unknown_change(spark):
    rows = spark.createDataFrame([event(0, 1, "added", "a b.py"), event(0, 2, "deleted", "c.py")], EVENT)
    assert [tuple(r) for r in changes.translate(rows, [".py"]).orderBy("seq").collect()] == [(1, "file:///r/a%20b.py", "Created"), (2, "file:///r/c.py", "Deleted")]
    with pytest.raises(PySparkException):
        rows.select(text.file_event_type(F.lit("moved"))).collect()


def test_labels_and_lists(spark):
    row = spark.range(1).select(text.change_label(F.lit("added")), text.split_list(F.lit(" a, ,b,")), text.split_list(F.lit(None).cast("string")), text.time_label(F.lit("2024-01-02 03:04:05.678999").cast("timestamp_ntz")), text.supports(F.lit(None).cast("map<string,boolean>"), "x")).first()
    assert tuple(row) == ("ADDED   ", ["a", "b"], [], "2024-01-02 03:04:05.678", False)


def test_language_kind(spark):
    assert spark.range(1).select(text.language_kind(F.lit("Python"))).first()[0] == "python"
    with pytest.raises(PySparkException, match="unknown language"):
        spark.range(1).select(text.language_kind(F.lit("klingon"))).collect()


def test_printed_order(spark):
    rows = spark.createDataFrame([event(0, 1, "deleted", "a"), event(0, 2, "added", "a"), event(0, 3, "added", "A")], EVENT)
    assert [r["line"] for r in changes.printed(rows).collect()] == ["ADDED     [r] A", "ADDED     [r] a", "DELETED   [r] a"]


def test_capped_starts_equal_a_plain_loop():
    import numpy as np

    from weftline.operators.changes import capped_starts

    def plain(times, gap, cap, start=None, last=None):
        out = []
        for t in times:
            if last is None or t - last > gap or t - start >= cap:
                start = t
            last = t
            out.append(start)
        return out

    rng = np.random.default_rng(5)
    for _ in range(300):
        times = np.sort(rng.integers(0, 60, int(rng.integers(0, 40))))
        gap, cap = int(rng.integers(0, 6)), int(rng.integers(1, 20))
        assert capped_starts(times, gap, cap).tolist() == plain(times, gap, cap)
        cut = int(rng.integers(0, len(times) + 1))
        first = capped_starts(times[:cut], gap, cap)
        open_ = (int(first[-1]), int(times[cut - 1])) if cut else (None, None)
        assert [*first.tolist(), *capped_starts(times[cut:], gap, cap, *open_).tolist()] == plain(times, gap, cap)
