"""Pointer doubling against a plain walk."""

import random

import pytest

from weftline.operators import intel, trees

KIND = "symbol_id string, parent_id string, name string"


def plain(rows):
    """id -> (level, path, top, reached), or None on a cycle or below one."""
    parent = {i: p for i, p, _ in rows}
    name = {i: n for i, _, n in rows}
    out = {}
    for i in parent:
        chain, at = [i], parent[i]
        while at is not None and at in parent and at not in chain:
            chain.append(at)
            at = parent[at]
        if at is not None and at in parent:
            out[i] = (None, None, None, "cycle")
        else:
            names = [name[x] for x in reversed(chain) if name[x] is not None]
            out[i] = (len(chain) - 1, "/".join(names), chain[-1], "root" if at is None else "orphan")
    return out


def result(df):
    return {r["symbol_id"]: (r["level"], r["path"], r["top"], r["reached"]) for r in df.collect()}


def chain(n, start=0, root=None):
    return [(f"s{start + k}", f"s{start + k - 1}" if k else root, f"n{k}") for k in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        chain(1),
        chain(1000),
        chain(33) + chain(40, 100, "missing") + [("x", "y", "x"), ("y", "x", "y"), ("below", "x", "b"), ("self", "self", "me"), ("deep", "below", None)],
        [("x", "y", "x"), ("y", "z", "y"), ("z", "x", "z")] + [(f"b{k}", "xyz"[k % 3], "b") for k in range(50)],
        [(f"r{k}", f"r{random.Random(k).randrange(k)}" if k % 9 else None, f"n{k % 5}") for k in range(700)],
    ],
    ids=["none", "one", "chain", "mixed", "cycles only", "random"],
)
def test_climb(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    assert result(intel.walk(df)) == plain(rows)
    if rows and not any(v[3] == "cycle" for v in plain(rows).values()) and len(rows) < 1000:
        deepest = max(v[0] for v in plain(rows).values()) + 1
        if deepest <= 9:  # the plan of a known depth grows with it
            assert result(intel.walk(df, deepest)) == plain(rows)


def test_known_depth_needs_no_job(spark):
    rows = chain(5) + chain(3, 50, "gone")
    df = spark.createDataFrame(rows, KIND)
    assert result(trees.walk(df, depth=5)) == plain(rows)
    assert result(intel.walk(df, 8)) == plain(rows)


def test_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    plain_round = trees._round
    monkeypatch.setattr(trees, "_round", lambda *a: rounds.append(1) or plain_round(*a))
    trees.climb(spark.createDataFrame(chain(1000), KIND))
    assert len(rounds) == 10
    rounds.clear()
    trees.climb(spark.createDataFrame(chain(20) + [("x", "y", "x"), ("y", "x", "y")], KIND))
    assert len(rounds) <= 7
