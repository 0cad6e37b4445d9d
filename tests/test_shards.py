"""The sharded tree source and sinks that send once."""

import json
import os

import pytest

from weftline.sources import shards, snapshots
from weftline.streaming import sinks, watch


def tree(path, names):
    for n in names:
        f = path / n
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(n)


NAMES = [f"d{k % 7}/e{k % 5}/{'x/y/' if k % 3 else ''}f{k}.py" for k in range(400)] + ["top.txt", "d1/one.txt", "d9/e1/z.txt"]


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards_cover_the_tree_once(tmp_path, n):
    tree(tmp_path, NAMES)
    got = [row for k in range(n) for row in shards.list_shard([str(tmp_path)], k, n)]
    want = snapshots.list_files([str(tmp_path)])
    assert sorted(p for p, *_ in got) == sorted(want) and {p: [m, s] for p, m, s in got} == want


def test_merge_equals_the_dictionaries():
    old = {f"p{k:03}": [k, 1] for k in range(0, 60, 2)} | {"a": [-1, -1]}
    new = {f"p{k:03}": [k if k % 4 else 0, 1] for k in range(0, 90, 3)} | {"b": [-1, -1]}
    rows = lambda d: iter(sorted((p, *v) for p, v in d.items()))
    assert list(shards.merged(rows(old), rows(new))) == snapshots.changes_between(old, new)


def batches_of(spark, path, store, sink, **options):
    spark.dataSource.register(shards.TreeSource)
    stream = spark.readStream.format("tree").option("roots", str(path / "w")).option("store", store).option("shards", "5").options(**options).load()
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start().awaitTermination()


def test_versions_as_offsets_and_a_replay_with_the_same_rows(spark, tmp_path):
    work, store = tmp_path / "w", f"file://{tmp_path}/store"
    tree(work, NAMES)
    told = []

    def keep(df, number):
        told.append((number, [tuple(r) for r in df.orderBy("pos").collect()]))

    batches_of(spark, tmp_path, store, keep)
    assert told == [] or told[-1][1] == []  # the first version is what changes are told from
    before = snapshots.list_files([str(work)])
    (work / "top.txt").write_text("longer than before")
    (work / NAMES[0]).unlink()
    tree(work, ["d1/e1/new/n.py", "q/r.py"])
    want = sorted((c, p, e, d) for c, p, e, d in snapshots.changes_between(before, snapshots.list_files([str(work)])))

    failed = []

    def fails(df, number):
        failed.append([tuple(r) for r in df.orderBy("pos").collect()])
        tree(work, ["after/the/listing.py"])
        raise RuntimeError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        batches_of(spark, tmp_path, store, fails)
    told.clear()
    batches_of(spark, tmp_path, store, keep)
    first = told[0][1]
    assert first == failed[0] and sorted(r[:4] for r in first) == want
    batches_of(spark, tmp_path, store, keep)
    rest = sorted(r[1] for _, rows in told[1:] for r in rows)
    assert rest == [str(work / p) for p in ("after", "after/the", "after/the/listing.py")]
    sizes = [len(line) for f in os.listdir(tmp_path / "c/offsets") if f.isdigit() for line in (tmp_path / "c/offsets" / f).read_text().splitlines() if "version" in line and "batchWatermarkMs" not in line]
    assert sizes and max(sizes) < 40
    assert len([v for v in os.listdir(tmp_path / "store")]) <= 4


def test_existing_files_can_be_told(spark, tmp_path):
    tree(tmp_path / "w", NAMES[:20])
    told = []
    batches_of(spark, tmp_path, str(tmp_path / "store"), lambda df, n: told.extend(tuple(r) for r in df.collect()), existing="true")
    assert {r[1] for r in told} == set(snapshots.list_files([str(tmp_path / "w")])) and {r[0] for r in told} == {"added"}
    assert len({r[4] for r in told}) == len(told)


def test_rows_are_sent_once(spark, tmp_path):
    log = sinks.SentLog(spark, f"file://{tmp_path}", "q")
    got = []

    def fails_at(key):
        def send(rows, k):
            if k == key:
                raise RuntimeError("receiver is down")
            got.append((k, rows))

        return send

    with pytest.raises(RuntimeError):
        sinks.send_once(iter(range(10)), 4, log, fails_at("4/2"), chunk=3)
    assert sinks.send_once(iter(range(10)), 4, log, fails_at(None), chunk=3) == 4
    assert sinks.send_once(iter(range(10)), 4, log, fails_at(None), chunk=3) == 0
    assert got == [("4/0", [0, 1, 2]), ("4/1", [3, 4, 5]), ("4/2", [6, 7, 8]), ("4/3", [9])]
    assert sinks.send_once(iter(()), 5, log, fails_at(None)) == 0
    for b in range(6, 9):
        sinks.send_once(iter([1]), b, log, fails_at(None), keep=1)
    assert sorted(os.listdir(tmp_path / "q")) == ["7", "8"]


def test_watch_sends_a_replayed_batch_once_and_in_order(spark, tmp_path):
    from weftline.model import WatchConfig

    work = tmp_path / "w"
    tree(work, ["a/x.py"])
    spark.dataSource.register(shards.TreeSource)
    got, down = [], [True]
    log = sinks.SentLog(spark, f"file://{tmp_path}/sent", "q")

    def send(rows, key):
        if down[0] and key.endswith("/1"):
            raise RuntimeError("receiver is down")
        got.extend(rows)

    def run():
        stream = spark.readStream.format("tree").option("roots", str(work)).option("store", f"file://{tmp_path}/store").option("shards", "4").load()
        cfg = WatchConfig(gitignore_filter=False, defaults_filter=False)
        watch.watch(stream, [(str(work), "w")], cfg, sinks.notify_once(send, [".py"], log, chunk=2), str(tmp_path / "c"), watch.NOW).awaitTermination()

    run()
    tree(work, [f"b{k}/n{k}.py" for k in range(7)])
    with pytest.raises(Exception, match="receiver is down"):
        run()
    assert len(got) == 2
    down[0] = False
    run()
    assert len(got) == 7 and len(set(got)) == 7 and {t for _, t in got} == {1}
    assert json.loads(json.dumps(sorted(got)))[0][0].endswith("n0.py")
