"""Operator 7: near-duplicate embeddings by cross-polytope hashing.

Each table rotates unit vectors by three rounds of random signs and the fast Hadamard transform, and the hash of a
rotation is the signed axis next to the vector; a table joins several such hashes. Multiprobing adds the buckets that
the least certain second choices give. The number of tables follows from the hashes in a table and the dimension, so
that the chance of a pair at the threshold to share a bucket does not depend on the number of vectors. Candidates of a bucket are compared by the signs of more rotations, then
verified by their cosine. Links exist only within the classes that verified links make, so each class is searched
exhaustively in blocks and every vector's links are counted without listing the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan
from weftline.llm.graph import SIGNATURE_ROWS, batch_stars, bucket_classes, shared
from weftline.llm.lineage import Shelf

THRESHOLD = 0.9
#: The least chance of a pair at the threshold to share a bucket of some table, whatever the hashes and the dimension.
RECALL = 0.995
#: Random pairs that a table's chance is estimated from, less two standard errors.
TRIALS = 20_000
#: The four buckets of a vector in a table: which of its least certain hashes take the second choice.
PROBES = ((), (0,), (1,), (0, 1))
#: Shorter vectors are padded to this size, since few axes make few different rotations.
LEAST_SIZE = 64
SEED = 7
#: Longs of sign bits in a sketch, and the bits of them in which vectors at the threshold may differ: the mean of 73.5 and five
#: deviations.
SKETCH = 8
SKETCH_BITS = 113
#: Components of the vectors of a class in one block, and vectors that are multiplied with it at once.
BLOCK = 1 << 18
STRIPE = 512
#: Cosines this near the threshold are computed again, by one formula everywhere.
DOUBT = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def _signs(dimension: int, number: int) -> np.ndarray:
    """The random signs of rotation number ``number``: the same on every executor."""
    return np.random.Generator(np.random.PCG64([SEED, dimension, number])).choice(np.array([-1.0, 1.0]), (3, dimension))


def padded(x: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a power of two."""
    return np.pad(x, ((0, 0), (0, padded_size(x.shape[1]) - x.shape[1])))


def padded_size(dimension: int) -> int:
    return max(LEAST_SIZE, 1 << (dimension - 1).bit_length())


def axes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two signed axes next to each row, nearest first, and how much nearer the first one is."""
    size = np.abs(r)
    order = np.argpartition(-size, 1, axis=1)[:, :2]
    pair = np.take_along_axis(size, order, 1)
    order = np.where((pair[:, 0] >= pair[:, 1])[:, None], order, order[:, ::-1])
    return order * 2 + (np.take_along_axis(r, order, 1) < 0), np.abs(pair[:, 0] - pair[:, 1])


@lru_cache(maxsize=None)
def table_chance(hashes: int, size: int, threshold: float = THRESHOLD) -> float:
    """The chance of a pair at the threshold to share a bucket of one table, from random pairs of that cosine, less two
    standard errors. size: padded dimension."""
    rng = np.random.Generator(np.random.PCG64([SEED, size, hashes]))
    hit, done, step = 0, 0, max(1, (1 << 20) // size)
    while done < TRIALS:
        n = min(step, TRIALS - done)
        done += n
        same, unsure = np.zeros((n, hashes, 2, 2), bool), np.zeros((2, n, hashes))
        for k in range(hashes):
            x, y = rng.normal(size=(n, size)), rng.normal(size=(n, size))
            x /= np.sqrt((x * x).sum(1))[:, None]
            y -= (x * y).sum(1)[:, None] * x
            y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * y / np.sqrt((y * y).sum(1))[:, None]
            (a, unsure[0, :, k]), (b, unsure[1, :, k]) = axes(x), axes(y)
            same[:, k] = a[:, :, None] == b[:, None, :]
        first = np.argsort(unsure, axis=2, kind="stable")
        choices = np.zeros((2, len(PROBES), n, hashes), np.int64)
        for p, turned in enumerate(PROBES):
            for u in turned:
                if u < hashes:
                    np.put_along_axis(choices[:, p], first[:, :, u : u + 1], 1, axis=2)
        met = np.zeros(n, bool)
        for p in choices[0]:
            for q in choices[1]:
                met |= same[np.arange(n)[:, None], np.arange(hashes), p, q].all(1)
        hit += int(met.sum())
    chance = hit / TRIALS
    return max(1 / TRIALS, chance - 2 * np.sqrt(chance * (1 - chance) / TRIALS))


def tables_for(hashes: int, size: int, threshold: float = THRESHOLD) -> int:
    """Tables of so many hashes that find a pair at the threshold with the chance RECALL. size: padded dimension."""
    return ceil(log(1 - RECALL) / log(1 - min(RECALL, table_chance(hashes, size, threshold))))


def hashes_for(vectors: int, size: int) -> int:
    """Hashes in a table, three at least, that keep buckets of unrelated vectors at about 8 or less. size: padded dimension."""
    return max(3, ceil(log(max(2, vectors) / 8) / log(2 * size)))


def bucket_keys(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """Signatures of unit rows: for each table the own bucket and three probes, as an array of rows x (4 tables)."""
    x = padded(x)
    n, d = x.shape
    rows = np.arange(n)
    out = []
    for t in range(tables):
        best, second, gap = [], [], []
        for k in range(hashes):
            r = rotate(x, _signs(d, t * hashes + k))
            axis, nearer = axes(r)
            best.append(axis[:, 0])
            second.append(axis[:, 1])
            gap.append(nearer)
        best, second = np.stack(best, 1), np.stack(second, 1)
        unsure = np.argsort(np.stack(gap, 1), axis=1, kind="stable")
        for turned in PROBES:
            choice = best.copy()
            for u in turned:
                if u < hashes:
                    choice[rows, unsure[:, u]] = second[rows, unsure[:, u]]
            code = np.full(n, t + 1, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(hashes):
                    code = code * np.uint64(2 * d + 1) + choice[:, k].astype(np.uint64)
            out.append(bytescan.mix(code))
    return np.stack(out, 1)


def sketches(x: np.ndarray) -> list[np.ndarray]:
    """Longs of 64 sign bits of further rotations of each row."""
    x = padded(x)
    d = x.shape[1]
    bits = np.concatenate([rotate(x, _signs(d, 10_000 + j)) for j in range(-(-64 * SKETCH // d))], 1)[:, : 64 * SKETCH] > 0
    return list(np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).T)


def linked(x: np.ndarray, y: np.ndarray, cosine: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether cosine reaches the threshold; x[i] and y[j] are the unit rows of each entry. The order of a sum decides the last digits, so
    entries in doubt are summed again in extended precision, the same way for candidates and within classes."""
    near = cosine >= threshold
    doubt = np.abs(cosine - threshold) < DOUBT
    if doubt.any():
        again = (x[i[doubt]].astype(np.longdouble) * y[j[doubt]]).sum(1)
        near[doubt] = again.astype(float) >= threshold
    return near


def _units(values: pa.Array, at: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision of those vectors that can be compared, and their places in the column."""
    values = values.cast(pa.list_(pa.float64()))
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    usual = np.bincount(lengths).argmax() if len(lengths) and at is None else at or 0
    good = np.flatnonzero((lengths == usual) & (lengths > 0))
    flat = values.take(pa.array(good)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(good), usual) if len(good) else np.zeros((0, max(usual, 1)))
    with np.errstate(all="ignore"):
        scale = np.abs(x).max(1) if x.size else np.zeros(len(x))
        fine = np.isfinite(scale) & (scale > 0)  # null components are NaN here
        x, good = x[fine] / scale[fine][:, None], good[fine]
        return x / np.sqrt((x * x).sum(1))[:, None], good


def _by_length(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit rows and places, one pair for each length of vectors in the column."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        if size:
            x, at = _units(values, int(size))
            if len(at):
                yield x, at


def _names(x: np.ndarray) -> np.ndarray:
    """A long for each row, equal for equal directions to 12 digits."""
    # + 0.0 turns -0.0 into 0.0
    raw = np.ascontiguousarray(np.round(x, 12) + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        power = bytescan.mix(np.arange(1, raw.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
        return bytescan.mix((bytescan.mix(raw) * power).sum(1, dtype=np.uint64) + np.uint64(raw.shape[1])).view(np.int64)


def name_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, size): node names the vector's direction, null if it cannot be compared; size is its padded dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.zeros(batch.num_rows, np.int64)
            known = np.zeros(batch.num_rows, bool)
            sizes = np.zeros(batch.num_rows, np.int32)
            for x, at in _by_length(batch.column(1)):
                names[at], known[at], sizes[at] = _names(x), True, padded_size(x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, mask=~known), pa.array(sizes, mask=~known)], ["vec_id", "node", "size"])

    return vectors.mapInArrow(run, "vec_id long, node long, size int")


def _named(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, values) of the vectors that can be compared: each row keeps its own vector, also under a repeated id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, at in _by_length(batch.column(1)):
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_names(x)), rows.column(1)], ["vec_id", "node", "values"])

    return vectors.mapInArrow(run, "vec_id long, node long, values array<double>")


def _with_units(vectors: DataFrame, schema: str, make) -> DataFrame:
    """make(nodes, unit rows) of all comparable vectors, each direction once a batch and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_no, batch in enumerate(batches):
            for x, at in _by_length(batch.column(1)):
                nodes, first = np.unique(_names(x), return_index=True)
                yield make(nodes, x[first], part_no)

    return vectors.mapInArrow(run, schema)


def _stripe(part: np.ndarray, x: np.ndarray, k: int, block: np.ndarray, both: bool, times: np.ndarray, threshold: float) -> np.ndarray:
    """The weighted number of rows of x linked with each of the rows from k on; of two blocks, those of the other block alone."""
    cosine = part @ x.T
    near = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < DOUBT)
    near[i, j] = linked(part, x, cosine[i, j], i, j, threshold)
    if both:
        near &= block[k : k + len(part), None] != block[None, :]
    else:
        near[np.arange(len(part)), k + np.arange(len(part))] = False
    return near @ times


def _class_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): of members (cell, node, times, values, left, right) sorted by cell, the weighted number of
    linked nodes found in each cell. A cell holds one block of a class or two; pairs within a block count in the cell of the block alone."""

    def links(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x, at = _units(rows["values"].combine_chunks(), len(rows["values"][0]))
        node, times, block = (rows[c].to_numpy()[at] for c in ("node", "times", "block"))
        both, found = block.min() != block.max(), np.zeros(len(x))
        for k in range(0, len(x), STRIPE):
            part = x[k : k + STRIPE]
            found[k : k + STRIPE] = _stripe(part, x, k, block, both, times, threshold)
        return node, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            cell = rows["cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    node, count = links(rows.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(count.astype(np.int64))], ["node", "links"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                table = pa.Table.from_batches(held)
                cell = table["cell"].to_numpy()
                cut = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on
                if cut:
                    yield from done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return members.mapInArrow(run, "node long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int | None = None, hashes: int | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id is its component's smallest).

    Repeated ids each keep their own vector; of equal ids in a component all are kept or none. Very long vectors are read
    whole. Other columns of vectors are not read; of no vectors there are no rows. Null and zero vectors, and those with null or non-finite components, link with nothing; vectors of different lengths do
    not link. Equal vectors link and share a class. Null ids stay null, with a null component, and are kept. hashes: hashes in a table; None takes three, or more
    for so many vectors that buckets of unrelated ones would hold over about 8. tables: None takes as many as RECALL needs with these hashes.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("values"))
    rows = shelf.put(name_vectors(source))
    plans = {}  # padded dimension: tables and hashes
    for size, number in rows.where("node is not null").groupBy("size").count().collect():
        own = hashes or hashes_for(number, size)
        plans[size] = (tables or tables_for(own, size, threshold), own)

    def signature_rows(nodes: np.ndarray, x: np.ndarray, part_no: int) -> pa.RecordBatch:
        keys = bucket_keys(x, *plans[padded_size(x.shape[1])])
        return batch_stars(keys.ravel().view(np.int64), np.repeat(nodes, keys.shape[1]), part_no)

    def sketch_rows(nodes: np.ndarray, x: np.ndarray, part_no: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), *map(pa.array, sketches(x))], ["node", *bits])

    bits = [f"s{k}" for k in range(SKETCH)]
    buckets = shelf.put(shared(_with_units(source, SIGNATURE_ROWS, signature_rows)))
    marked = buckets.select("node").union(buckets.select("center")).distinct()
    short = shelf.put(_with_units(source, "node long, " + ", ".join(f"{b} long" for b in bits), sketch_rows).join(marked, "node", "left_semi").dropDuplicates(["node"]))
    distinct = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("smallest"), F.count("vec_id").alias("times"))

    def fits(a, b):
        return reduce(lambda x, y: x + y, [F.bit_count(a(s).bitwiseXOR(b(s))) for s in bits]) <= SKETCH_BITS

    def verify(close: DataFrame) -> DataFrame:
        wanted = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
        holders = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("vec_id").alias("vec_id"))
        full = shelf.put(_named(source.join(holders.select("vec_id").distinct(), "vec_id", "left_semi")).join(holders, ["vec_id", "node"]).dropDuplicates(["node"]).select("node", "values"))
        u, v = (full.select(F.col("node").alias(k), F.col("values").alias(f"v{k}")) for k in "ab")
        both = close.join(u, "a").join(v, "b").where(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(lengths):
                    some = batch.take(pa.array(np.flatnonzero(lengths == size)))
                    (x, _), (y, _) = (_units(some.column(c), int(size)) for c in (2, 3))
                    at = np.arange(len(x))
                    hit = pa.array(linked(x, y, (x * y).sum(1), at, at, threshold))
                    yield pa.RecordBatch.from_arrays([some.column(0).filter(hit), some.column(1).filter(hit)], ["a", "b"])

        return both.mapInArrow(near, "a long, b long")

    classes = bucket_classes(buckets, short, fits, verify, shelf)
    shelf.clear(rows, classes)
    # search each class exhaustively: blocks of its members by hash, a cell for each pair of blocks
    sizes = classes.groupBy("component").agg(F.count("*").alias("size"))
    dimensions = rows.where("node is not null").groupBy("node").agg(F.first("size").alias("dimension"))
    blocks = F.ceil(F.col("size") / F.greatest(F.lit(256), F.lit(BLOCK) / F.col("dimension"))).cast("int")
    placed = classes.join(sizes, "component").join(distinct, "node").join(dimensions, "node").where("smallest is not null").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = _named(source.where("vec_id is not null")).join(placed.select("node", "component", "times", "blocks", "block", F.col("smallest").alias("vec_id")), ["vec_id", "node"])
    cells = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("cell", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = cells.select("cell", "node", "times", "block", "values").dropDuplicates(["cell", "node"]).repartition(parts, "cell").sortWithinPartitions("cell")
    links = _class_links(members, threshold).groupBy("node").agg(F.sum("links").alias("links"))

    named = rows.join(distinct, "node", "left").join(classes, "node", "left").join(links, "node", "left")
    lowest = classes.join(distinct, "node").groupBy("component").agg(F.min("smallest").alias("lowest"))
    out = named.join(lowest, "component", "left").withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("lowest", "smallest", "vec_id")))
    alone = F.col("node").isNull() | F.col("vec_id").isNull()
    return out.select("vec_id", F.when(alone, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), n AS (
  SELECT a, count(*) AS n_links FROM link GROUP BY a
), c AS (
  SELECT a, min(b) AS least FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
