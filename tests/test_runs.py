"""Capped batches over range partitions against a scan by key."""

import random

import pytest

from weftline.operators import changes

SCHEMA = "event_id long, k string, us long, note string"


def plain(rows, gap, cap):
    out = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        start = last = None
        for r in own:
            if start is None or r[2] - last > gap or r[2] >= start + cap:
                start = r[2]
            out[r[0]] = start
            last = r[2]
    return out


def made(kind):
    rng = random.Random(kind)
    if kind == "hot":  # one key has half of the events, in runs of about 50
        times = []
        t = 0
        for k in range(3000):
            t += rng.randrange(1, 5) if k % 50 else 1000
            times.append(t)
        return [(k, "hot", t, "n") for k, t in enumerate(times)] + [(5000 + k, f"k{k % 40}", rng.randrange(40_000), None) for k in range(3000)]
    if kind == "one run":  # never a gap, so all partitions are one run
        return [(k, "a", 2 * k + k % 2, "n") for k in range(2000)]
    if kind == "ties":
        return [(k, rng.choice(["a", None, "b"]), rng.choice([0, 0, 5, 100, 104]), "n") for k in range(200)]
    return [(1, "a", 7, "n")] if kind == "single" else []


@pytest.mark.parametrize("parts", [1, 5, 16])
@pytest.mark.parametrize("kind", ["hot", "one run", "ties", "single", "none"])
def test_equals_a_scan_by_key(spark, kind, parts):
    rows = made(kind)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = changes.capped_batches(spark.createDataFrame(rows, SCHEMA), "k", "us", "event_id", 10, 60)
        assert got.columns == ["event_id", "k", "us", "note", "batch_start"]
        assert {r["event_id"]: r["batch_start"] for r in got.collect()} == plain(rows, 10, 60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_key_spreads_and_only_border_runs_are_scanned_again(spark, monkeypatch):
    seen = {}
    border_runs = changes.border_runs
    monkeypatch.setattr(changes, "border_runs", lambda borders, gap: seen.setdefault("borders", borders) and border_runs(borders, gap))
    rows = made("hot")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        changes.capped_batches(spark.createDataFrame(rows, SCHEMA), "k", "us", "event_id", 10, 60).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hot = [b for b in seen["borders"] if "hot" in (b["first_key"], b["last_key"])]
    assert len(hot) >= 5 and all(b["runs"] > 3 for b in hot)
