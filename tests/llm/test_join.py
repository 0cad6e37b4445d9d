"""The shingle join against brute force."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import WORDS, empty, odd_documents
from weftline.llm import shinglejoin as J
from weftline.llm.graph import components
from weftline.llm.lineage import Shelf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 4 else zip(*(words[k:] for k in range(4)), strict=False))


def brute(rows):
    """(id, text) rows: id -> (sizes, component), all pairs compared."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t))
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[int(rng.integers(len(out)))] = f"n{rng.integers(1 << 30)}"
    return " ".join(out)


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(40):
        n = int(rng.choice([3, 4, 5, 9, 10, 11, 14, 20, 40, 90, 300]))
        base = [f"g{g}w{k}" for k in range(n)]
        for c in range(int(rng.integers(1, 7))):
            rows.append(near(rng, base, int(rng.integers(0, max(1, n // 30) + 1))) if c else " ".join(base))
    passage = [f"p{k}" for k in range(60)]  # shared by many texts that are not near copies
    rows += [" ".join([f"u{d}x{k}" for k in range(50)] + passage) for d in range(40)]
    chain = [f"c{k}" for k in range(140)]
    rows += [" ".join(chain[k : k + 110]) for k in range(0, 30, 3)]  # each near the next, the ends far apart
    rows += ["A b C d E", "a B c D e", "", "one", "ONE"]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got) and len(got) == len(rows)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = J.jaccard_classes(docs).collect()
    assert len(got) == docs.count()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    assert J.jaccard_classes(empty(spark)).count() == 0


def test_keep_one(spark):
    docs = odd_documents(spark)
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect())
    # 0 stands for its copies 0, 1 and the near copy 7 (which differs in one of 57 shingles' words); 5 is repeated
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert ids == sorted([-1, -1, *{i for i, c in want.items() if i == c}])
    assert J.keep_one_of_each(empty(spark)).count() == 0
    simple = spark.createDataFrame([(3, " ".join(WORDS)), (1, " ".join(WORDS)), (2, None), (4, "other")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in J.keep_one_of_each(simple).collect()) == [1, 2, 4]


def test_difference_bound_is_exact():
    def slow(s):
        best = 0
        for t in range(s, s * 100 // 85 + 1):
            common = -(-85 * (s + t) // 185)
            if common <= s:
                best = max(best, s + t - 2 * common)
        return best

    sizes = [*range(1, 300), 1000, 4999, 12_345, 30_000]
    assert [J.most_differences(s) for s in sizes] == [slow(s) for s in sizes]


#: Corpora in which next to nothing, much and nearly everything is shared.
FALL = np.array([[1.0, 0.6, 0.3, 0.15, 0.08, 0.05]])
RATES = [()] + [tuple((k, tuple(map(tuple, (np.array([m]).T * FALL).tolist()))) for k in range(14)) for m in ((3.0, 1.0, 0.4, 0.1, 0.02), (900.0, 300.0, 60.0, 2.0, 0.001))]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.floats(0, 0.2), st.floats(0, 0.2), st.sampled_from(RATES), st.sampled_from([80, 85]))
def test_qualifying_pairs_share_a_signature(n, seed, lose, gain, rates, percent):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    y = np.unique(np.concatenate([x[int(len(x) * lose) :], rng.integers(0, 1 << 63, int(len(x) * gain)).astype(np.uint64)]))
    if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
        assert len(np.intersect1d(J.signatures(x, percent, rates), J.signatures(y, percent, rates)))
        bits = sum(bin(int(a) & (1 << 64) - 1 ^ int(b) & (1 << 64) - 1).count("1") for a, b in zip(J.parity(x), J.parity(y), strict=True))
        assert (100 + percent) * bits <= (100 - percent) * (len(x) + len(y))


@pytest.mark.parametrize("kind", ["whole", 0, 3, 6])
def test_each_kind_of_segment_finds_every_qualifying_pair_alone(kind):
    """Pairs at the very threshold, with plans of one kind only and no further level."""
    rng = np.random.default_rng(9)
    for n in (8, 30, 31, 90, 250):
        edges = J.band_edges(1 << n.bit_length())
        band = int(np.searchsorted(edges, n, "right")) - 1
        need = max(J.most_differences(s) for s in range(edges[band], edges[band + 1])) + 1
        plan = (need + 8, 0, 0, 1, 8) if kind == "whole" else (0, (need + 1) // 2 + 4, kind, 1, 8)
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = x[: -(-85 * len(x) // 100)]  # the smaller side decides the band
            y = np.concatenate([y, rng.integers(0, 1 << 63, max(0, edges[band] - len(y))).astype(np.uint64)])
            if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)) or not edges[band] <= min(len(x), len(y)):
                y = x[:-1] if n > 8 else x
            (a, fine), (b, good) = (J._signatures(z, band, plan, 0) for z in (x, y))
            assert not (fine or good) or len(np.intersect1d(a, b))
            (a, fine), (b, good) = (J._signatures(z, band, (*plan[:3], 3, plan[4]), 0) for z in (x, y))
            assert not (fine or good) or len(np.intersect1d(a, b))


def test_allocation_follows_what_is_shared():
    """Whole segments where chance matches are rare; subsets and then one-deletion neighbourhoods as they grow."""
    kinds = lambda rates: [J.allocation(n, n + max(1, n // 3), 0, 85, rates)[1:3] for n in (10, 18, 40, 150, 300, 1000)]
    assert all(v == 0 for v, _ in kinds(())[3:])
    assert any(v and q for rates in RATES for v, q in kinds(rates))
    assert any(v and not q for v, q in kinds(RATES[2]))


def test_signatures_stay_in_proportion():
    """However much is shared: about as many as agreements are needed."""
    rng = np.random.default_rng(0)
    for n in (150, 400, 1200):
        need = J.most_differences(n) + 1
        own = [np.mean([len(J._signatures(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)), k, J.allocation(n, n + n // 4, 0, 85, rates), 0)[0]) for k in range(5)]) for rates in RATES]
        assert max(own) <= 1.45 * 1.25 * need + 12


def test_sets_of_one_shingle_have_a_signature_of_their_own():
    for rates in RATES:
        found = [J.signatures(np.array([k], np.uint64), 85, rates) for k in range(200)]
        assert len(np.unique(np.concatenate(found))) == sum(map(len, found))


def test_match_rates_are_counts(spark):
    rows = corpus()
    named = J._scan(spark.createDataFrame(rows, "doc_id long, text string"), 4, "names", J._NAMED)
    sets = {r["node"]: r for r in named.collect() if r["node"] is not None}.values()
    got = dict(J.match_rates(named))
    for scale in {int(np.log2(r["n_shingles"])) for r in sets}:
        for k in range(len(J.PROBES)):
            for least in J.LEAST:
                sigs = [r["probes"][k] for r in sets if int(np.log2(r["n_shingles"])) == scale and r["held"][k] >= least]
                want = sum(sigs.count(s) - 1 for s in sigs) / sum(int(np.log2(r["n_shingles"])) == scale for r in sets)
                assert got[scale][k][least - 1] == pytest.approx(want)


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(k, k + 1) for k in range(50)], [(0, k) for k in range(1, 40)], [(1, 2), (3, 4), (4, 5), (9, 1)]])
def test_components(spark, pairs):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Shelf(spark)).collect()}
    want = {}
    for a, b in pairs:
        old = {want.get(a, a), want.get(b, b)}
        for n in [*want, a, b]:
            if want.get(n, n) in old:
                want[n] = min(old)
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32), st.floats(0, 0.3), st.floats(0, 0.3))
def test_wide_bitmaps_lose_nothing_and_tell_large_sets_apart(n, seed, lose, gain):
    rng = np.random.default_rng(seed)
    x, z = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in "xz")
    y = np.unique(np.concatenate([x[int(len(x) * lose) :], rng.integers(0, 1 << 63, int(len(x) * gain)).astype(np.uint64)]))
    far = lambda a, b: J.wide_difference(J.wide_parity(a).tobytes(), J.wide_parity(b).tobytes())
    assert far(x, y) <= len(np.setxor1d(x, y))
    if n >= 500:
        assert 180 * far(x, z) > 20 * 2 * n
