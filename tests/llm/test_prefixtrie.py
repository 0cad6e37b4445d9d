"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import prefixtrie
from weftline.llm.louds import Louds, parents_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, conv long, k1 string, depth double"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    nodes = {}
    for c, ts in own.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(base, [])[:h] + ts[h:]
        for d in range(len(seq) + 1):
            node = nodes.setdefault(tuple(seq[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(seq):
                node["ends"].append(c)
    out = []
    for key, node in sorted(nodes.items(), key=lambda kv: -len(kv[0])):
        node.setdefault("kids", 0)
        node["leaves"] = node.get("leaves", 0) + (node["kids"] == 0)
        words = len(WORD.findall(key[-1][1])) if key else 0
        node["saved"] = node.get("saved", 0) + (len(node["members"]) - 1) * words
        up = nodes[key[:-1]] if key else None
        if up is not None:
            up["kids"] = up.get("kids", 0) + 1
            up["leaves"] = up.get("leaves", 0) + node["leaves"]
            up["saved"] = up.get("saved", 0) + node["saved"]
        ids = ",".join(map(str, sorted(node["ends"])))
        out.append((min(node["members"]), len(key), min(up["members"]) if up else None, len(node["members"]), node["kids"], node["leaves"], node["saved"], hashlib.sha256(ids.encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(kind):
    rng = random.Random(kind)
    if kind == "mixed":  # few different turns, so prefixes are shared; ids of both signs, absent heads, null turns
        rows = [(c, t if t or c % 3 else None, rng.choice(["user", None, ""]), rng.choice(["a b", "c", "", None, "x  y z"])) for c in range(-70, 300) if c % 20 or c % 40 for t in range(rng.randrange(1, 7))]
        return rows + rows[:50] + [(None, 1, "user", "a"), (None, None, None, None)]
    if kind == "copies":  # a third of all conversations are alike, and one is a prefix of them
        rows = [(c, t, "user", f"hello {t}") for c in range(0, 2000, 20) for t in range(6)]
        rows += [(c, t, "user", f"turn {rng.randrange(3)} of it") for c in range(1, 2000, 17) for t in range(5)]
        return rows + [(4001, 0, "user", "hello 0"), (4020, 0, "user", "hello 0")]
    if kind == "long":  # one conversation holds most rows and has two near copies and a family of its own
        rows = [(c, t, "user", f"w {t % 5} {t // 700}") for c in (40, 43, 60) for t in range(1500 if c < 60 else 1400)]
        return rows + [(c, t, "bot", "ok") for c in range(41, 59) if c != 43 for t in range(3)] + [(7, 0, "user", "single")]
    if kind == "one":
        return [(5, 0, "user", "only turn")]
    return []


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("kind", ["mixed", "copies", "long", "one", "none"])
def test_equals_plain_prefixes(spark, kind, parts):
    rows = made(kind)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], SCHEMA)
        assert rows_of(prefixtrie.trie(df)) == sorted(plain(rows), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_shards_and_hash_rows_give_the_same(spark, monkeypatch):
    rows = made("mixed") + [(c, t, "user", f"same {t}") for c in range(1000, 1400, 20) for t in range(9)]
    df = spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], SCHEMA)
    monkeypatch.setattr(prefixtrie, "IDS", 3)
    want = sorted(plain(rows), key=repr)
    assert rows_of(prefixtrie.trie(df, shard=5)) == want
    assert rows_of(prefixtrie.trie(df, shard=1, levels=3)) == want


def test_louds_has_the_parents_that_it_was_made_from():
    rng = np.random.default_rng(3)
    parent = np.array([-1, -1, -1] + [int(rng.integers(0, k)) for k in range(3, 400)])
    level = np.zeros(400, np.int64)
    for k in range(3, 400):
        level[k] = level[parent[k]] + 1
    keys = np.stack([rng.permutation(400), rng.permutation(400)], 1)
    shuffled = rng.permutation(400)
    above = np.where(parent[shuffled, None] >= 0, keys[parent[shuffled]], -7)
    found = parents_of(keys[shuffled], above)
    place = np.empty(400, np.int64)
    place[shuffled] = np.arange(400)
    assert (found == np.where(parent[shuffled] >= 0, place[parent[shuffled]], -1)).all()
    trie = Louds(found, level[shuffled], keys[shuffled])
    assert len(trie) == 401 and len(trie.bits) == 2 * 400 + 1 and trie.bits.sum() == 400
    up = trie.parents()
    assert all((up[k] == 0) == (found[trie.rows[k]] < 0) and (up[k] == 0 or trie.rows[up[k] - 1] == found[trie.rows[k]]) for k in range(400))
    values = rng.integers(0, 9, 400)
    want = values.copy()
    for k in sorted(range(400), key=lambda k: -level[shuffled][k]):
        if found[k] >= 0:
            want[found[k]] += want[k]
    assert (trie.rollup(values) == want).all() and (trie.children() == np.bincount(found[found >= 0], minlength=400)).all()
