"""Operator 13: the prefix trie of conversations, by succinct level-order tries over prefix shards.

A node is a distinct sequence of first turns. Nodes are named by a Horner sum of the turns' SHA-256 digests modulo 2^127 - 1,
so only digests, word counts and ids are shuffled, never texts. Turns are range-partitioned by conversation and order; a scan
names the prefixes, and what a partition cannot know, as a family of conversations began before it, is finished with the
state at the partition's border, which is folded from one small summary of each partition. So a conversation with any number
of turns spreads over partitions like any other rows.

Nodes with one member need no trie: below the last shared node a conversation is a chain. The shared nodes are grouped into
shards by their first turn, and where a shard has too many nodes by longer prefixes; a shard's task builds a LOUDS trie in numpy
and sums over subtrees in reverse level order. The nodes above the shards, each of which has more than ``SHARD`` nodes below,
are merged by a trie of their own from their shards' sums.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.lineage import Shelf, small_side
from weftline.llm.louds import Louds, parents_of

#: Conversations c share the head of c - c % FAMILY, of which each takes crc32(c) % HEADS turns.
FAMILY, HEADS = 20, 4
#: Shared nodes up to which a prefix is one shard, and levels down to which larger ones are parted.
SHARD = 200_000
LEVELS = 64
#: Conversation ids that are joined to one row before they are hashed.
IDS = 65_536

_MOD = (1 << 127) - 1
_BASE = 0x2F0B4C471D6E8F3B5A9C7E1D3B5F7A91 % _MOD
_LOW = (1 << 64) - 1
_HALF = 1 << 63

MEMBER, END, RAW, SUMMARY = range(4)
_SCAN = "kind int, part int, conv long, depth long, k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, words long, more binary"


def split(key: int) -> tuple[int, int]:
    """A name as two signed longs."""
    return key >> 64, (key & _LOW) - _HALF


def head_of(conv: int, family: int = FAMILY) -> int:
    """conv - conv % family with the remainder's sign of SQL."""
    return conv - (abs(conv) % family) * (1 if conv >= 0 else -1)


def horner(digests: list[int], start: int = 0) -> int:
    for d in digests:
        start = (start * _BASE + d) % _MOD
    return start


class Walk:
    """Names prefixes along turns in order: of a family the head conversation first, and each conversation's turns in order."""

    def __init__(self, family: int = FAMILY, heads: int = HEADS):
        self.family, self.heads = family, heads
        self.base = self.conv = None
        self.head: list[tuple[int, int]] = []  # the head conversation's first turns: digest, words
        self.at = self.depth = self.name = self.top = 0

    def state(self) -> tuple:
        return self.base, self.conv, list(self.head), self.at, self.depth, self.name, self.top

    def resume(self, state: tuple) -> Walk:
        self.base, self.conv, head, self.at, self.depth, self.name, self.top = state
        self.head = list(head)
        return self

    def dropped(self) -> int:
        """How many of the conversation's own first turns are replaced."""
        return 0 if self.conv == self.base else zlib.crc32(str(self.conv).encode()) % self.heads

    def end(self) -> tuple:
        return (END, self.conv, self.depth, *split(self.name), None, None, None, None, None)

    def begin(self, conv: int) -> list[tuple]:
        base = head_of(conv, self.family)
        if base != self.base:
            self.base, self.head = base, []
        self.conv, self.at, self.depth, self.name, self.top = conv, 0, 0, 0, 0
        return [self.step(d, w) for d, w in self.head[: self.dropped()]]

    def step(self, digest: int, words: int) -> tuple:
        before, self.name = self.name, (self.name * _BASE + digest) % _MOD
        self.depth += 1
        if self.depth == 1:
            self.top = self.name
        return (MEMBER, self.conv, self.depth, *split(self.name), *split(before), *split(self.top), words)

    def turn(self, digest: int, words: int) -> tuple | None:
        """The next own turn of the conversation; None if the head's turn stands in its place."""
        at = self.at
        self.at += 1
        if self.conv == self.base and len(self.head) < self.heads - 1:
            self.head.append((digest, words))
        return self.step(digest, words) if at >= self.dropped() else None


def turns(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """(conv, foreign, turn, digest, words) of turns with a conversation: null role and text are empty; the digest tells role and text
    apart."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(conv.isNotNull()).select(conv.alias("conv"), F.col("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    base = F.col("conv") - F.col("conv") % family
    return rows.select(base.alias("base"), (F.col("conv") != base).alias("foreign"), "conv", "turn", "digest", "words")


def _batches(rows: Iterator[tuple], part: int, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of scan rows (kind, conv, depth, key, parent, top, words[, more])."""
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 9, pa.binary()]
    names = [c.split()[0] for c in _SCAN.split(", ")]
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*[(r[0], part, *r[1:], *(() if len(r) == 11 else (None,))) for r in held], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def scan(rows: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Scan rows of turns in range partitions: members and ends of all families but a partition's first, whose turns are given
    raw with their order as depth; and of each partition with rows a summary."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "base", "foreign", "conv", "turn").sortWithinPartitions("base", "foreign", "conv", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def found() -> Iterator[tuple]:
            walk = Walk(family, heads)
            first = None
            opening: list[int] = []  # of the first family: the head conversation's first digests here,
            opening_words: list[int] = []
            last: dict = {}  # and of the family's last conversation its turns here, their first digests and Horner sum
            count = 0
            for batch in batches:
                for conv, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv", "digest", "words")), strict=True):
                    d = int.from_bytes(digest, "big") % _MOD
                    base = head_of(conv, family)
                    if first is None:
                        first = (base, conv)
                    if base == first[0]:
                        if last.get("conv") != conv:
                            last = {"conv": conv, "n": 0, "digests": [], "words": [], "sum": 0}
                        if conv == base and len(opening) < heads - 1:
                            opening.append(d)
                            opening_words.append(words)
                        if len(last["digests"]) < heads:
                            last["digests"].append(d)
                        last["n"] += 1
                        last["sum"] = (last["sum"] * _BASE + d) % _MOD
                        yield (RAW, conv, count, *split(d), None, None, None, None, words)
                        count += 1
                        continue
                    if conv != walk.conv:
                        if walk.conv is not None:
                            yield walk.end()
                        yield from walk.begin(conv)
                    if (row := walk.turn(d, words)) is not None:
                        yield row
            if first is not None:
                summary = {"first": first, "head": list(zip(opening, opening_words, strict=True)), "last": last, "state": walk.state() if walk.conv is not None else None}
                yield (SUMMARY, None, None, *[None] * 7, pickle.dumps(summary))

        yield from _batches(found(), part)

    columns = dealt.select("conv", "digest", "words")
    return columns.mapInArrow(run, _SCAN)


def after_first_family(start: tuple | None, summary: dict, family: int = FAMILY, heads: int = HEADS) -> tuple:
    """The state after the raw turns of a partition's first family, from the state before them. Only the last conversation matters,
    and its name is composed from the Horner sum of its turns here."""
    walk = Walk(family, heads)
    if start is not None:
        walk.resume(start)
    base, last = summary["first"][0], summary["last"]
    if walk.base != base:
        walk.base, walk.head = base, []
        walk.conv = None
    walk.head = (walk.head + summary["head"])[: heads - 1]
    if walk.conv != last["conv"]:
        walk.begin(last["conv"])
    drop = min(last["n"], max(0, walk.dropped() - walk.at))
    taken = last["n"] - drop
    if taken:
        rest = (last["sum"] - horner(last["digests"][:drop]) * pow(_BASE, taken, _MOD)) % _MOD
        if walk.depth == 0:
            walk.top = last["digests"][drop]
        walk.name = (walk.name * pow(_BASE, taken, _MOD) + rest) % _MOD
        walk.depth += taken
    walk.at += last["n"]
    return walk.state()


def borders(summaries: dict[int, dict], family: int = FAMILY, heads: int = HEADS) -> tuple[dict[int, tuple], list[tuple]]:
    """The state before each partition, and the ends of conversations that end with a partition."""
    states, ends = {}, []
    state = None
    walk = Walk(family, heads)
    for part in sorted(summaries):
        s = summaries[part]
        if state is not None and state[1] != s["first"][1]:
            ends.append(walk.resume(state).end())
        states[part] = state
        state = s["state"] if s["state"] is not None else after_first_family(state, s, family, heads)
    if state is not None:
        ends.append(walk.resume(state).end())
    return states, ends


def named(conversations: DataFrame, shelf: Shelf, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Scan rows of kinds MEMBER and END for all conversations: each rebuilt turn, and where each conversation ends."""
    spark = conversations.sparkSession
    found = shelf.put(scan(turns(conversations, family), family, heads))
    # one row for each partition, so the driver's part does not grow with its rows
    summaries = {r["part"]: pickle.loads(bytes(r["more"])) for r in found.where(F.col("kind") == SUMMARY).select("part", "more").collect()}
    states, ends = borders(summaries, family, heads)
    closed = {p for p, s in summaries.items() if s["state"] is not None}

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        walk = Walk(family, heads)
        if states[part] is not None:
            walk.resume(states[part])
        out, here = [], False
        rows = rows.sort_values("depth")
        for conv, k1, k2, words in zip(*(rows[c].tolist() for c in ("conv", "k1", "k2", "words")), strict=True):
            if conv != walk.conv:
                if here:
                    out.append(walk.end())
                out += walk.begin(conv)
            here = True
            if (row := walk.turn((k1 << 64) + k2 + _HALF, words)) is not None:
                out.append(row)
        if part in closed and here:
            out.append(walk.end())
        names = ["kind", "conv", "depth", "k1", "k2", "p1", "p2", "t1", "t2", "words"]
        return pd.DataFrame({n: pd.array(c, "Int64") for n, c in zip(names, zip(*out, strict=True), strict=True)} if out else {n: pd.array([], "Int64") for n in names})

    # the rows of one partition's first family at most: bounded by a partition's size
    schema = "kind int, conv long, depth long, k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, words long"
    rest = found.where(F.col("kind") == RAW).groupBy("part").applyInPandas(finish, schema)
    border = spark.createDataFrame(ends, schema)
    columns = [c.split()[0] for c in schema.split(", ")]
    out = shelf.put(rest.unionByName(border))
    return found.where(F.col("kind") <= END).select(*columns).unionByName(out.select(*columns))


_ROOT = split(0)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of nodes where two or more conversations end, from (k1, k2, conv).

    Ids are sorted by range, so a node with very many spreads over tasks, and joined to rows of up to IDS ids; the hash of such
    rows is the only step by node.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(parts, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, whole = None, [], False  # whole: the node's ids can't go on in the partition before
        out: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            types = [pa.int64()] * 4 + [pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "first", "n", "ids"])

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = (a, b) != key
                if new or len(ids) >= IDS:
                    if len(ids) > 1 or (ids and not (whole and new)):
                        out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
                        size += len(out[-1][4])
                    whole = new and key is not None
                    key, ids = (a, b), []
                    if size > 4 << 20:
                        yield made()
                        out, size = [], 0
                ids.append(conv)
        if ids:
            out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
        if out:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, hasher = None, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([hasher.hexdigest()])], ["k1", "k2", "ends_sha256"])

        for batch in batches:
            for a, b, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != key:
                    if total > 1:
                        yield row()
                    key, total, hasher = (a, b), 0, hashlib.sha256()
                hasher.update((("," if total else "") + ids).encode())
                total += n
        if total > 1:
            yield row()

    rows = dealt.select("k1", "k2", "conv").mapInArrow(join, "k1 long, k2 long, first long, n long, ids string")
    by_node = rows.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "n", "ids")
    return by_node.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


_FOREST = ["k1", "k2", "p1", "p2", "t1", "t2", "level", "conv", "depth", "parent_conv", "n", "words", "n_ends", "ended", "below", "leaves_below", "saved_below"]
_ROLLED = "k1 long, k2 long, p1 long, p2 long, level long, conv long, depth long, parent_conv long, n long, n_ends long, ended long, n_children long, n_leaves long, saved long"


def rolled(forest: pd.DataFrame) -> pd.DataFrame:
    """Sums over subtrees of the shared nodes of some shards. below: children outside the forest, with their leaves and savings."""
    keys, above = forest[["k1", "k2"]].to_numpy(np.int64), forest[["p1", "p2"]].to_numpy(np.int64)
    level = forest["level"].to_numpy(np.int64)
    parent = np.where(level > 0, parents_of(keys, above), -1)
    trie = Louds(parent, level, keys)
    children = trie.children() + forest["below"].to_numpy(np.int64)
    leaves = forest["leaves_below"].to_numpy(np.int64) + (children == 0)
    saved = forest["saved_below"].to_numpy(np.int64) + (forest["n"].to_numpy(np.int64) - 1) * forest["words"].to_numpy(np.int64)
    out = forest[["k1", "k2", "p1", "p2", "level", "conv", "depth", "parent_conv", "n", "n_ends", "ended"]]
    return out.assign(n_children=children, n_leaves=trie.rollup(leaves), saved=trie.rollup(saved))


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rolled() of whole shards that come sorted by shard, about SHARD nodes at a time."""
    held: list[pd.DataFrame] = []
    size = 0

    def made(frame: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(rolled(frame.reset_index(drop=True)), preserve_index=False)

    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        held.append(frame)
        size += len(frame)
        if size >= SHARD:
            whole = pd.concat(held)
            t1, t2 = whole["t1"].to_numpy(), whole["t2"].to_numpy()
            open_ = np.flatnonzero((t1 != t1[-1]) | (t2 != t2[-1]))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            if cut:
                yield made(whole.iloc[:cut])
            held, size = [whole.iloc[cut:]], 0  # the last shard may go on
    if held:
        yield made(pd.concat(held))


def labelled(shared: DataFrame, members: DataFrame, shelf: Shelf, shard: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Shared nodes with the shard (t1, t2) that they are in and their level there, and the nodes above all shards.

    A prefix of one turn is a shard; while one has more than ``shard`` nodes, its top goes up and its children become shards. The
    name of a node's prefix of any length is found by its smallest member, which is a member of all nodes above it.
    """
    rest = shared.withColumn("at", F.lit(1).cast("long"))
    light, upper = [], []
    for level in range(1, levels + 1):
        heavy = shelf.put(rest.groupBy("t1", "t2").agg(F.count("*").alias("size")).where(F.col("size") > shard).select("t1", "t2"))
        if not heavy.take(1):
            break
        heavy = small_side(heavy)
        light.append(rest.join(heavy, ["t1", "t2"], "left_anti"))
        below = rest.join(heavy, ["t1", "t2"], "left_semi")
        upper.append(below.where(F.col("depth") == level))
        prefix = members.where(F.col("depth") == level + 1).select("conv", F.col("k1").alias("n1"), F.col("k2").alias("n2"))
        moved = below.where(F.col("depth") > level).join(prefix, "conv").withColumns({"t1": F.col("n1"), "t2": F.col("n2"), "at": F.lit(level + 1).cast("long")})
        rest = shelf.put(moved.select(*rest.columns))
    light.append(rest)
    union = lambda tables: tables[0].select(*rest.columns) if len(tables) == 1 else tables[0].select(*rest.columns).unionByName(union(tables[1:]))
    return union(light), union(upper) if upper else rest.limit(0)


def trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, shard: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix trie, the root included: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, and those of equal turn by the digest of role and text; repeated rows are turns of
    their own. Null roles and texts are empty; rows with a null conv_id belong to no conversation and are left out; an
    empty table has no conversation and no node, so no row. Texts of any length are hashed and counted where they are read;
    other columns are not read.
    """
    spark = conversations.sparkSession
    shelf = Shelf(spark)
    rows = named(conversations, shelf, family, heads)
    members, ends = rows.where(F.col("kind") == MEMBER), rows.where(F.col("kind") == END)
    counted = rows.where("depth > 0").groupBy("k1", "k2").agg(
        F.min("depth").alias("depth"), F.count_if(F.col("kind") == MEMBER).alias("n"), F.min("conv").alias("conv"), F.max("words").alias("words"),
        F.count_if(F.col("kind") == END).alias("n_ends"), F.coalesce(F.min(F.when(F.col("kind") == END, F.col("conv"))), F.lit(0)).alias("ended"), *[F.min(c).alias(c) for c in ("p1", "p2", "t1", "t2")],
    )
    nodes = shelf.put(counted)
    top = ends.agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.count_if(F.col("depth") == 0).alias("n_ends"), F.coalesce(F.min(F.when(F.col("depth") == 0, F.col("conv"))), F.lit(0)).alias("ended")).first()
    names = small_side(shelf.put(nodes.where("n > 1").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up"))))
    first = nodes.where("depth = 1").withColumn("up", F.lit(top["conv"]).cast("long"))
    placed = shelf.put(nodes.where("depth > 1").join(names, ["p1", "p2"], "left").unionByName(first))

    # below a shared node each child with one member is a chain with one leaf
    chains = placed.where("n = 1 and up is not null").groupBy("p1", "p2").agg(F.count("*").alias("below"))
    chains = chains.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "below")
    shared = placed.where("n > 1").join(chains, ["k1", "k2"], "left").withColumns({"below": F.coalesce("below", F.lit(0).cast("long")), "parent_conv": F.col("up")})
    shared = shelf.put(shared.withColumns({"leaves_below": F.col("below"), "saved_below": F.lit(0).cast("long")}).drop("up"))
    light, upper = labelled(shared, members, shelf, shard, levels)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = light.withColumn("level", F.col("depth") - F.col("at")).select(*_FOREST)
    lower = shelf.put(forest.repartition(parts, "t1", "t2").sortWithinPartitions("t1", "t2", "depth").mapInArrow(_sharded, _ROLLED))

    # the upper levels: at most one node a level for each ``shard`` nodes, and the root
    root_key = spark.createDataFrame([_ROOT] if top["n"] else [], "k1 long, k2 long")
    lone = placed.where("n = 1 and depth = 1").count()
    root = root_key.select(
        "k1", "k2", *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "t1", "t2", "depth", "words", "saved_below", "parent_conv")], F.lit(top["n"]).alias("n"), F.lit(top["conv"]).cast("long").alias("conv"),
        F.lit(top["n_ends"]).alias("n_ends"), F.lit(top["ended"]).cast("long").alias("ended"), *[F.lit(lone).cast("long").alias(c) for c in ("below", "leaves_below")],
    )
    sums = lower.where("level = 0").groupBy("p1", "p2").agg(F.count("*").alias("b"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    sums = sums.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "b", "l", "s")
    above = upper.drop("at").unionByName(root).join(sums, ["k1", "k2"], "left")
    added = {c: F.col(c) + F.coalesce(a, F.lit(0)) for c, a in (("below", "b"), ("leaves_below", "l"), ("saved_below", "s"))}
    above = above.withColumns(added | {"level": F.col("depth")}).select(*_FOREST)
    merged = above.coalesce(1).mapInArrow(_sharded_whole, _ROLLED)

    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    shared_rows = lower.unionByName(merged)
    digests = shelf.put(ends_digests(ends.select("k1", "k2", "conv")))
    shared_rows = shared_rows.join(small_side(digests), ["k1", "k2"], "left")
    ended = F.when(F.col("n_ends") == 0, none).when(F.col("n_ends") == 1, sha(F.col("ended"))).otherwise(F.col("ends_sha256"))
    long = lambda c: F.lit(c).cast("long")
    out = shared_rows.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), ended.alias("ends_sha256"))
    chain = placed.where("n = 1").select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("up", "conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(F.col("n_ends") > 0, 0).otherwise(1).cast("long").alias("n_children"),
        long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(F.col("n_ends") > 0, sha(F.col("conv"))).otherwise(none).alias("ends_sha256"),
    )
    return out.unionByName(chain)


def _sharded_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rolled() of all rows as one trie whose only top is the root."""
    frames = [b.to_pandas() for b in batches if b.num_rows]
    if frames:
        yield pa.RecordBatch.from_pandas(rolled(pd.concat(frames, ignore_index=True)), preserve_index=False)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT c, c - c % 20 AS base, CASE WHEN c % 20 = 0 THEN [] ELSE list_transform(string_split(c::VARCHAR, ''), lambda b: ascii(b)::UBIGINT) END AS b FROM (SELECT DISTINCT c FROM t)),
heads AS (SELECT c, base, CASE WHEN len(b) = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)::UBIGINT[]), lambda s, k: xor(s >> 1, (s & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 4 END AS h FROM bytes),
rebuilt AS (SELECT heads.c, t.pos, r, x FROM heads JOIN t ON t.c = base AND pos <= h UNION ALL SELECT heads.c, pos, r, x FROM heads JOIN t USING (c) WHERE pos > h),
seq AS (SELECT c, coalesce(list(sha256(strlen(r)::VARCHAR || ':' || r || x) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s,
    coalesce(list(len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))::BIGINT ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w FROM heads LEFT JOIN rebuilt USING (c) GROUP BY c),
steps AS (SELECT c, d, s[1:d] AS k, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(s) AS last FROM seq, unnest(range(len(s) + 1)) u(d)),
nodes AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ids FROM steps GROUP BY k),
kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (SELECT v.k[1:d] AS k, sum((v.n_convs - 1) * v.words)::BIGINT AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM nodes v LEFT JOIN kids USING (k), unnest(range(v.depth + 1)) u(d) GROUP BY ALL)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves, sums.saved AS saved_tokens, sha256(nodes.ids) AS ends_sha256
FROM nodes LEFT JOIN kids USING (k) JOIN sums USING (k) LEFT JOIN nodes up ON nodes.depth > 0 AND up.k = nodes.k[1:nodes.depth - 1]"""
