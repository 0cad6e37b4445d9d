"""Candidate buckets and connected components over long node ids.

Nodes that share a signature form a bucket. Only classes are wanted, so a bucket's nodes are first compared with one of
them (a star, made within each Arrow batch before the shuffle and then across batches). Buckets whose nodes are still
in different classes get a second star around the node that most such buckets hold, and then all their remaining pairs
of different classes, so that no link that joins two classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytescan
from weftline.llm.lineage import Shelf


def components(edges: DataFrame, shelf: Shelf, most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay the same: the number of rounds grows with the
    logarithm of the nodes (``most`` rounds; a RuntimeError beyond, never a wrong answer). Smallest neighbours come from partial aggregation, and they are joined back to the edges, so
    no node's neighbours are gathered in one place and a hot node's join can be split.
    """
    now = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("n"), F.least("a", "b").alias("low"))
        large = both.join(low, both["a"] == low["n"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = shelf.put(large)
        down = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
        pairs = large.join(down, large["a"] == down["n"])
        small = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).union(pairs.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        small = shelf.put(small)
        digest = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        shelf.drop(now, large)
        now = small
        if before == tuple(digest):
            break
        before = tuple(digest)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


SIGNATURE_ROWS = "key long, node long, sig long, center long"


def batch_stars(sigs: np.ndarray, nodes: np.ndarray, part_no: int) -> pa.RecordBatch:
    """Rows to shuffle: of each signature's nodes within the batch only the smallest goes to the signature's key; the
    others have found their centre already and are dealt out evenly."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    first = np.ones(len(sigs), bool)
    first[1:] = sigs[1:] != sigs[:-1]
    center = nodes[np.maximum.accumulate(np.where(first, np.arange(len(sigs)), 0))]
    key = np.where(first, sigs, bytescan.mix((sigs + nodes + part_no).view(np.uint64)).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes), pa.array(sigs, mask=first), pa.array(center, mask=first)], ["key", "node", "sig", "center"])


def shared(rows: DataFrame) -> DataFrame:
    """Of signature rows as batch_stars makes them: those that share their signature, as (sig, node, center)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = seen_node = None  # of the last row
        last_node = center = None  # the last row's node while it is the only one of its key, and the key's centre
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            local = np.asarray(batch.column(2).is_valid().to_numpy(zero_copy_only=False), bool)
            if not len(key):
                continue
            out_sig, out_node, out_center = [], [], []
            if local.any():
                own = batch.filter(pa.array(local))
                out_sig.append(own.column(2).to_numpy())
                out_node.append(own.column(1).to_numpy())
                out_center.append(own.column(3).to_numpy())
            key, node = key[~local], node[~local]
            if len(key):  # copies of a set from several tasks count once
                copy = np.zeros(len(key), bool)
                copy[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1])
                copy[0] = last_key is not None and key[0] == last_key and node[0] == seen_node
                key, node = key[~copy], node[~copy]
            if len(key):
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                carried = last_key is not None and key[0] == last_key
                if carried:
                    first[0] = False
                start = np.flatnonzero(first)
                run_of = np.cumsum(first)  # 0 for the rows of the carried key
                centers = np.concatenate([[center if carried else 0], node[start]])[run_of]
                sizes = np.bincount(run_of, minlength=len(start) + 1)
                many = sizes[run_of] > 1
                if carried:
                    many[run_of == 0] = True
                    if last_node is not None:  # the carried key's only row so far has waited for company
                        out_sig.append(np.array([last_key]))
                        out_node.append(np.array([last_node]))
                        out_center.append(np.array([center]))
                out_sig.append(key[many])
                out_node.append(node[many])
                out_center.append(centers[many])
                last_key, seen_node = key[-1], node[-1]
                center = centers[-1]
                alone = not many[-1]
                last_node = node[-1] if alone else None
            if out_sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_sig, out_node, out_center)], ["sig", "node", "center"])

    return rows.repartition(parts, "key").sortWithinPartitions("key", "node").mapInArrow(run, "sig long, node long, center long")


def bucket_classes(buckets: DataFrame, traits: DataFrame, fits: Callable[[Callable, Callable], Column], verify: Callable[[DataFrame], DataFrame], shelf: Shelf) -> DataFrame:
    """(node, component) of the nodes that link with others.

    buckets: (sig, node, center), stored. traits: narrow columns of each node in a bucket, stored. fits gives the condition on
    the traits of two nodes (functions from a trait's name to its column) that a pair must meet to be verified; verify
    keeps those of the distinct pairs (a, b), a < b, that truly link.
    """
    names = [c for c in traits.columns if c != "node"]
    own, other = (traits.select(F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in names]) for k in "ab")
    fit = fits(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))

    def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def fitting(pairs: DataFrame) -> DataFrame:
        return shelf.put(pairs.join(own, "a").join(other, "b").where(fit).select("a", "b"))

    tried = fitting(ordered(buckets, "node", "center"))
    edges = shelf.put(verify(tried))
    classes = shelf.put(components(edges, shelf))
    members = shelf.put(buckets.select("sig", "node").union(buckets.select("sig", F.col("center").alias("node"))).distinct())
    for step in ("popular", "all"):
        labelled = members.join(classes, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("class"))
        still = labelled.groupBy("sig").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        rest = shelf.put(labelled.join(still.select("sig", "size"), "sig"))
        if step == "popular":
            weight = rest.groupBy("node").agg(F.sum("size").alias("weight"))
            top = rest.join(weight, "node").groupBy("sig").agg(F.max_by("node", F.struct("weight", "node")).alias("center"), F.max_by("class", F.struct("weight", "node")).alias("center_class"))
            pairs = fitting(ordered(rest.join(top, "sig").where("class <> center_class"), "node", "center"))
        else:  # the traits are part of the join's condition, so that pairs without a chance are never made
            left = rest.select("sig", F.col("node").alias("a"), F.col("class").alias("a__")).join(own, "a")
            right = rest.select(F.col("sig").alias("sig_"), F.col("node").alias("b"), F.col("class").alias("b__")).join(other, "b")
            pairs = ordered(left.join(right, (F.col("sig") == F.col("sig_")) & (F.col("a__") < F.col("b__")) & fit), "a", "b")
        fresh = shelf.put(pairs.join(tried, ["a", "b"], "left_anti"))
        more = shelf.put(verify(fresh))
        tried = tried.union(fresh)
        if not more.isEmpty():
            edges = edges.union(more)
            classes = shelf.put(components(edges, shelf))
    return classes
