"""Operator 1: exact n-gram Jaccard self-join by partitioning the universe of shingles.

A document's set is its distinct word n-grams, as 64-bit hashes. Sets fall into size bands. For a band, the largest
number of differences d that a qualifying pair can have is known, so the universe is cut by hash into segments and a
pair must agree on some of them (pigeonhole). A segment has a value: one if the pair must be equal in it to agree, two if
it may differ there in one element; when the values sum to more than d, some segment agrees. Three kinds are indexed:

* whole segments (value one): a hash of the elements;
* subsets of a segment (value two): the segment is cut into q parts and all but one of them are hashed, for each part;
* one-deletion neighbourhoods (value two): the segment and the segment without each of its elements are hashed.

Signatures of fewer than t elements match too much and are not indexed (t is one or more: an empty one proves nothing);
a set in which they take more value than its band has in reserve moves on to a rehashed level (the last one indexes
deletions of any size and takes any set), and a pair is found on the first level on which either set is satisfied.

The kinds that a band takes, how many of each, t and the reserve are the cheapest by the signatures to shuffle and the
chance matches to compare. Chance matches are measured: every document gives one segment of each of a few mean sizes, and
how many other sets of the band hold the same segment is counted over all documents. Each candidate is verified on the
full sets.

Only classes are returned, so buckets are compared as graph.bucket_classes says. Before the full sets are compared, a
pair must fit in size and in parity bitmaps: bits that differ cannot outnumber the elements that differ, so this
filter loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erfc, exp, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import bytescan
from weftline.llm.graph import batch_stars, bucket_classes, shared
from weftline.llm.lineage import Shelf, small_side

N_WORDS = 4
PERCENT = 85
#: A band's sizes grow by this factor.
BAND = 1.3
#: Levels of rehashing for sets with many small signatures; the last one takes any set.
LEVELS = 3
#: Parts of a segment of which all but one are hashed.
PARTS = (3, 4, 6)
#: Mean sizes of the segments whose matches are counted.
PROBES = (1, 2, 4, 8, 16)
#: Least numbers of elements that a band may ask of its signatures.
LEAST = (1, 2, 3, 4, 5, 6)
#: Chance matches of a signature of one element that are assumed beside the counted ones, and the factor by which each further
#: element of LEAST lessens them: one segment of a band is a small sample, and a passage that many texts share may miss it.
ASSUMED, LESSENED = 2.0, 0.15
#: What a signature that another set shares by chance costs, next to one that none shares: it is written, paired and compared.
MATCH_COST = 12.0
#: Signatures that a set may have on average, for each agreement that its band needs, and beside those: what the join
#: shuffles stays in proportion to its input, however much is shared. It is a matter of cost alone and loses no pair.
MOST, FREE = 1.45, 12
#: What an empty signature costs, for each match of a signature of one element: it is the same for all sets of a band.
EMPTY_COST = 1000.0
#: Names of sets that a task remembers, to pass on copies once.
SEEN = 200_000
#: Words of 64 bits in a set's parity bitmap.
PARITY = 8

def most_differences(size: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of a set of this size with a set as large or larger that still qualifies."""
    worst, top = 0, size * 100 // percent
    # the bound grows with the partner's size but for a jitter of two, which takes under 30 sizes to outgrow
    for other in range(max(size, top - 30), top + 1):
        total = size + other
        common = -(-percent * total // (100 + percent))
        if common <= size:
            worst = max(worst, total - 2 * common)
    return worst


@lru_cache(maxsize=None)
def band_edges(most: int, band: float = BAND) -> tuple[int, ...]:
    """Lower edges of the bands: single sizes first, then growing by the factor."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * band)))
    return tuple(edges)


#: Measured matches: for each power of two of the sizes, for each mean size in PROBES and each number in LEAST, the mean number
#: of other sets that share a segment with as many elements at least. Hashable, so that allocations are made once a worker.
Rates = tuple[tuple[int, tuple[tuple[float, ...], ...]], ...]


def _match_rate(rates: Rates, size: float, covered: float, least: int) -> float:
    """Chance matches of a signature that covers so many elements on average, of sets of this size."""
    table, assumed = dict(rates), ASSUMED * LESSENED ** (least - 1)
    if not table:
        return assumed
    near = min(table, key=lambda k: (abs(k - log2(max(1.0, size))), k))
    counted = np.array([r[least - 1] for r in table[near]])
    chance = np.maximum(0.0, counted - counted[-1])  # what the largest segments share are near copies, which any plan meets
    return assumed + float(np.exp(np.interp(log(max(covered, 0.1)), np.log(PROBES), np.log(chance + 1e-9))))


def _over(mean: float, at_most: int) -> float:
    """The chance of a Poisson count to exceed at_most."""
    if mean > 400:  # the normal curve serves
        return 0.5 * erfc((at_most + 0.5 - mean) / sqrt(2 * mean))
    term = total = exp(-mean)
    for k in range(1, at_most + 1):
        term *= mean / k
        total += term
    return max(0.0, 1 - total)


def allocation(low: int, high: int, level: int, percent: int = PERCENT, rates: Rates = ()) -> tuple[int, int, int, int, int]:
    """(k, v, q, t, reserve) for sets of sizes low to high - 1 as the smaller side: k whole segments, v segments of value two,
    their parts (0: one-deletion neighbourhoods), the least elements of a signature, and the value that smaller ones may take away.

    The cost of a plan, of those that MOST and FREE admit, is its signatures for a set of the middle size, plus MATCH_COST for each of their measured chance
    matches, plus the next level's cost times the chance that the set must move on.
    """
    return _cheapest(low, high, level, percent, rates)[2]


@lru_cache(maxsize=None)
def _cheapest(low: int, high: int, level: int, percent: int, rates: Rates) -> tuple[float, float, tuple[int, int, int, int, int]]:
    """The cost and the expected signatures of the cheapest plan, from this level on, and the plan."""
    need = max(most_differences(s, percent) for s in range(max(low, high - 30), high)) + 1
    size = max(1.0, (low + high - 1) / 2)
    if level == LEVELS - 1:
        v = (need + 1) // 2
        late = v + size
        # empty signatures are indexed here, and every set that has one shares it
        empty = v * exp(-size / v) * (1 + size / v)
        cost = late * (1 + MATCH_COST * _match_rate(rates, size, max(0.1, size / v - 1), 1)) + EMPTY_COST * empty * max(1.0, _match_rate(rates, size, 1, 1))
        return cost, late, (0, v, 0, 0, 0)
    onward, more, _ = _cheapest(low, high, level + 1, percent, rates)
    best = None
    for spare in sorted({0, 1, 2, 3, 4, 6, 8, *(round(need * f / 100) for f in (3, 5, 7, 10, 13, 17, 22, 30, 40, 60, 90))}):
        spare += level * max(1, need // 4)
        total = need + spare
        unit = size / total
        for v in sorted({0, total // 4, total // 2}):
            k = total - 2 * v
            for q in (0, *PARTS) if v else (0,):
                covered = 2 * unit * (1 - 1 / q) if q else max(0.1, 2 * unit - 1)
                late = v * (q or 1 + 2 * unit)
                for t in LEAST:
                    # value that is lost: whole segments, and segments of value two with any signature, of under t elements
                    small = k * (1 - _over(unit, t - 1) if total > 1 else float(low < t))
                    small_late = v * min(1.0, q * (1 - _over(covered, t - 1)) if q else 1 - _over(2 * unit, t))
                    unmet = _over(small + 2 * small_late, spare) if v == 0 else _over(small / 2 + small_late, spare // 2)
                    matches = k * _match_rate(rates, size, unit, t) + late * _match_rate(rates, size, covered, t)
                    rows = k * (_over(unit, t - 1) if total > 1 else float(low >= t)) + late * _over(covered, t - 1)
                    cost, rows = rows + MATCH_COST * matches + unmet * onward, rows + unmet * more
                    over = max(0.0, rows - (MOST + level) * need - FREE)
                    if best is None or (over, cost) < best[0]:
                        best = ((over, cost), rows, (k, v, q, t, spare))
    return best[0][1], best[1], best[2]


_ELEMENT = np.uint64(0x5851F42D4C957F2D)


def _segment_names(n: int, salt: np.uint64) -> np.ndarray:
    return (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) + salt


def _salt(band: int, level: int) -> np.uint64:
    return np.uint64((band * LEVELS + level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def _signatures(elements: np.ndarray, band: int, plan: tuple[int, int, int, int, int], level: int) -> tuple[np.ndarray, bool]:
    """Signatures of one set under a band's plan, and whether its small signatures leave enough agreements (t = 0: always)."""
    k, v, q, t, reserve = plan
    salt = _salt(band, level)
    with np.errstate(over="ignore"):
        mixed = bytescan.mix(elements + salt)
        unit = ((mixed >> np.uint64(32)) * np.uint64(k + 2 * v) >> np.uint64(32)).astype(np.int64)
        own = bytescan.mix(mixed ^ _ELEMENT)
        late = unit >= k
        out, lost = [], 0
        if k:
            at = unit[~late]
            sums = np.zeros(k, np.uint64)
            np.add.at(sums, at, own[~late])
            large = np.bincount(at, minlength=k) >= t
            lost += k - int(large.sum())
            out.append(bytescan.mix(sums + _segment_names(k, salt))[large])
        if v:
            at, own = (unit[late] - k) >> 1, own[late]
            sizes = np.bincount(at, minlength=v)
            parts = q or 1
            names = _segment_names(v * parts, salt ^ _ELEMENT)
            sums = np.zeros(v, np.uint64)
            np.add.at(sums, at, own)
            if q:
                part = at * q + (mixed[late] & np.uint64(0xFFFF)).astype(np.int64) % q
                within = np.zeros(v * q, np.uint64)
                np.add.at(within, part, own)
                rest = np.repeat(sizes, q) - np.bincount(part, minlength=v * q)
                out.append(bytescan.mix(np.repeat(sums, q) - within + names)[rest >= t])
                lost += 2 * int((rest.reshape(v, q) < t).any(1).sum())
            else:  # the segment itself and the segment without each element
                whole, less = bytescan.mix(sums + names), bytescan.mix(sums[at] - own + names[at])
                out += [whole[sizes >= t], less[sizes[at] > t]] if t else [whole, less]
                lost += 2 * int((sizes <= t).sum())
    return np.concatenate(out), not t or lost <= reserve


def signatures(elements: np.ndarray, percent: int = PERCENT, rates: Rates = ()) -> np.ndarray:
    """All signatures of one set of hashes: of its own band and of the lower bands that hold possible partners."""
    n = len(elements)
    edges = band_edges(1 << n.bit_length())
    own = int(np.searchsorted(edges, n, "right")) - 1
    least = -(-percent * n // 100)
    out = []
    for band in range(int(np.searchsorted(edges, max(1, least), "right")) - 1, own + 1):
        for level in range(LEVELS):
            found, enough = _signatures(elements, band, allocation(edges[band], edges[band + 1], level, percent, rates), level)
            out.append(found)
            if enough:
                break
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def probes(elements: np.ndarray) -> tuple[list[int], list[int]]:
    """One segment of each mean size in PROBES, as a signed long that sets of one band share if they are equal in it, and
    its number of elements."""
    n = len(elements)
    band = int(np.searchsorted(band_edges(1 << n.bit_length()), n, "right")) - 1
    sums, sizes = np.zeros(len(PROBES), np.uint64), []
    with np.errstate(over="ignore"):
        mixed = bytescan.mix(elements + _salt(band, LEVELS))
        for k, size in enumerate(PROBES):
            inside = mixed[(mixed >> np.uint64(32)) * np.uint64(max(1, round(n / size))) >> np.uint64(32) == 0]
            sums[k] = bytescan.mix(inside ^ _ELEMENT).sum(dtype=np.uint64)
            sizes.append(len(inside))
        return bytescan.mix(sums + _segment_names(len(PROBES), _salt(band, LEVELS))).view(np.int64).tolist(), sizes


def match_rates(rows: DataFrame) -> Rates:
    """Chance matches, counted over all distinct sets of the named rows (node, n_shingles, probes, held): a few numbers for
    each power of two of the sizes come to the driver."""
    one = rows.where("node is not null").groupBy("node").agg(F.floor(F.log2(F.first("n_shingles"))).cast("int").alias("scale"), F.first("probes").alias("probes"), F.first("held").alias("held"))
    sets = dict(one.groupBy("scale").count().collect())
    flat = one.select("scale", F.posexplode(F.arrays_zip("probes", "held")).alias("probe", "p")).select("scale", "probe", "p.probes", F.least("p.held", F.lit(len(LEAST))).alias("held")).where("held > 0")
    shared_by = flat.groupBy("scale", "probe", "held", "probes").agg(F.count("*").alias("c")).where("c > 1")
    found = shared_by.groupBy("scale", "probe", "held").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("met")).collect()
    table = {scale: np.zeros((len(PROBES), len(LEAST))) for scale in sets}
    for r in found:
        table[r["scale"]][r["probe"], : r["held"]] += r["met"] / sets[r["scale"]]
    return tuple((scale, tuple(map(tuple, table[scale].tolist()))) for scale in sorted(table))


def document_sets(buf: np.ndarray, offsets: np.ndarray, n_words: int = N_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice; words are lower-cased in A-Z."""
    low = bytescan.LOWER[buf]
    starts, ends = bytescan.spans(low, offsets, bytescan.WORD_SEPARATORS)
    hashes = bytescan.span_hashes(low, starts, ends)
    cuts = bytescan.document_of(starts, offsets).tolist()
    multiplier = np.uint64(0xE7037ED1A0B428DB)
    size = max(0, len(hashes) - n_words + 1)
    grams = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n_words):
            grams = grams * multiplier + hashes[k : k + size]
        grams = bytescan.mix(grams + np.uint64(n_words))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= n_words:
                yield np.unique(grams[a : b - n_words + 1])
            elif b > a:
                whole = np.uint64(0)
                for h in hashes[a:b]:
                    whole = whole * multiplier + h
                yield bytescan.mix(np.array([whole + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_name(elements: np.ndarray) -> int:
    """A 64-bit name of a set, equal for equal sets, as a signed long."""
    with np.errstate(over="ignore"):
        raw = bytescan.mix(elements + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(bytescan.mix(np.array([raw], np.uint64)).view(np.int64)[0])


_BITS = [f"p{k}" for k in range(PARITY)]


def parity(elements: np.ndarray) -> np.ndarray:
    """The parity bitmap: bit h is set if an odd number of elements hash to h."""
    counts = np.bincount((bytescan.mix(elements ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(55)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)


def wide_parity(elements: np.ndarray) -> np.ndarray:
    """A parity bitmap, packed into bytes, of the next power of two over the size in bits, 512 at least. Of two bitmaps
    the longer folds onto the shorter."""
    bits = max(512, 1 << len(elements).bit_length())
    places = (bytescan.mix(elements ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8))


def wide_difference(x: bytes, y: bytes) -> int:
    """Bits in which two wide bitmaps differ at the shorter one's length: never more than the elements that differ."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    size = min(len(a), len(b))
    both = np.bitwise_xor.reduce(a.reshape(-1, size), axis=0) ^ np.bitwise_xor.reduce(b.reshape(-1, size), axis=0)
    return int(np.bitwise_count(both).sum())


def _scan(rows: DataFrame, n_words: int, what: str, schema: str, percent: int = PERCENT, rates: Rates = ()) -> DataFrame:
    """One pass over (doc_id, text): 'names' (_NAMED), 'signatures' (key, node, sig, center) or 'sets' (node, n, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of late; copies that it has forgotten meet in the shuffle
        part_no = 0
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                part_no += 1
                if len(seen) > SEEN:
                    seen.clear()
                if what == "names":
                    names, sizes, segments, held = [], [], [], []
                    for s in document_sets(buf, offsets, n_words):
                        names.append(set_name(s) if len(s) else None)
                        sizes.append(len(s))
                        one, filled = probes(s) if len(s) else (None, None)
                        segments.append(one)
                        held.append(filled)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(segments, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int32()))], ["doc_id", "node", "n_shingles", "probes", "held"])
                elif what == "sets":
                    kept, names, sizes = [], [], []
                    for s in document_sets(buf, offsets, n_words):
                        if len(s) and (name := set_name(s)) not in seen:
                            seen.add(name)
                            kept.append(s.view(np.int64))
                            names.append(name)
                            sizes.append(len(s))
                    if kept:
                        bits = np.stack([parity(k.view(np.uint64)) for k in kept])
                        wide = pa.array([wide_parity(k.view(np.uint64)).tobytes() for k in kept], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(b) for b in bits.T), wide, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(kept)))], ["node", "n", *_BITS, "wide", "elements"])
                else:
                    found, names = [], []
                    for s in document_sets(buf, offsets, n_words):
                        if len(s) and (name := set_name(s)) not in seen:  # exact copies in a task count once
                            seen.add(name)
                            found.append(signatures(s, percent, rates))
                            names.append(name)
                    if found:
                        yield batch_stars(np.concatenate(found).view(np.int64), np.repeat(np.array(names, np.int64), [len(f) for f in found]), part_no)

    return rows.mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets qualify, by the exact sizes of the sets and their intersection."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(k) for k in range(6))
            rows = zip(na.to_pylist(), nb.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)
            keep = pa.array([(100 + percent) * wide_difference(p, q) <= (100 - percent) * (m + n) for m, n, p, q in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    # bitmaps that grow with the sets, so that the sets themselves travel only for pairs that are likely to qualify
    left, right = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}")) for k in "ab")
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(close, "a long, b long")
    left, right = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("elements").alias(f"e{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


_NAMED = "doc_id long, node long, n_shingles long, probes array<long>, held array<int>"


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT, shelf: Shelf | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, node, n_shingles) for each input row, where node names the row's set, and
    classes (node, class) for the nodes that link with others."""
    spark = docs.sparkSession
    shelf = shelf or Shelf(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = shelf.put(_scan(texts, n_words, "names", _NAMED))
    rows = named.drop("probes", "held")

    found = _scan(texts.select("doc_id", "text"), n_words, "signatures", "key long, node long, sig long, center long", percent, match_rates(named))
    buckets = shelf.put(shared(found))

    # the sets of the nodes in shared buckets, scanned again from one row of each node
    wanted = buckets.select("node").union(buckets.select(F.col("center").alias("node"))).distinct()
    holders = shelf.put(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null"))
    sets = shelf.put(_scan(texts.join(small_side(holders.select("doc_id").distinct()), "doc_id", "left_semi"), n_words, "sets", "node long, n long, " + "".join(f"{b} long, " for b in _BITS) + "wide binary, elements array<long>").join(holders.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    def fits(a, b):
        bits = sum((F.bit_count(a(p).bitwiseXOR(b(p))) for p in _BITS[1:]), F.bit_count(a(_BITS[0]).bitwiseXOR(b(_BITS[0]))))
        small, large = F.least(a("n"), b("n")), F.greatest(a("n"), b("n"))
        return (100 * small >= percent * large) & (bits * (100 + percent) <= (100 - percent) * (small + large))

    classes = bucket_classes(buckets, sets.drop("wide", "elements"), fits, lambda pairs: _verified(pairs, sets, percent), shelf)
    shelf.clear(named, classes)
    return rows, classes.withColumnRenamed("component", "class")


def component_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with component_id: the smallest doc_id of the row's class. Empty sets and null ids stand alone."""
    named = rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    smallest = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"), "node")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest linked doc_id, itself included).

    Null and empty texts have empty sets and link with nothing; very long texts are read whole. Rows with a null id get a
    null component. Repeated rows and copies share a class; of no documents there are no rows. Other columns are not read.
    """
    return component_ids(*link_classes(docs, id_col, text_col, n_words, percent)).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all but one row of each class: the row with the smallest doc_id (of repeated ids the first set and one
    of its rows). Rows with empty sets or null ids link with nothing and stay; very long texts are compared whole. All
    columns stay as they are, whatever their names.
    """
    shelf = Shelf(docs.sparkSession)
    rows, classes = link_classes(docs, id_col, text_col, n_words, percent, shelf)
    placed = rows.where("doc_id is not null and node is not null").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    best = placed.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    spare = placed.join(best, "class").where((F.col("doc_id") != F.col("best.doc_id")) | (F.col("node") != F.col("best.node"))).select("doc_id", "node")
    lost = shelf.put(spare.distinct())
    again = rows.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = shelf.put(again)
    mark = "__keep"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    # ids that stand once lose their row by id alone; of repeated ids each row's set decides
    single = shelf.put(lost.join(again, "doc_id", "left_anti").select("doc_id").distinct())
    key = F.col(id_col).cast("long")
    left = docs.join(small_side(single.withColumnRenamed("doc_id", mark)), key == F.col(mark), "left_anti")
    if again.isEmpty():
        return left
    repeated = left.join(small_side(again.withColumnRenamed("doc_id", mark)), key == F.col(mark), "left_semi")
    others = left.join(small_side(again.withColumnRenamed("doc_id", mark)), key == F.col(mark), "left_anti")
    texts = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = _name_rows(repeated, id_col, text_col, mark, n_words)
    kept = kept.join(lost.withColumnRenamed("doc_id", mark + "_id").withColumnRenamed("node", mark + "_node"), (key == F.col(mark + "_id")) & (F.col(mark) == F.col(mark + "_node")), "left_anti")
    # of equal ids with equal sets one row stays; rows without a set all stay
    named = kept.where(F.col(mark).isNotNull())
    once = named.withColumn(mark + "_rank", F.row_number().over(Window.partitionBy(key, F.col(mark)).orderBy(texts))).where(F.col(mark + "_rank") == 1)
    return others.unionByName(once.select(*docs.columns)).unionByName(kept.where(F.col(mark).isNull()).select(*docs.columns))


def _name_rows(docs: DataFrame, id_col: str, text_col: str, name: str, n_words: int) -> DataFrame:
    """docs with the name of each row's set."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, text_col):
                names = [set_name(s) if len(s) else None for s in document_sets(buf, offsets, n_words)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.int64())], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(documents.doc_id, coalesce(low.b, documents.doc_id)) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN low ON low.a = documents.doc_id
"""
