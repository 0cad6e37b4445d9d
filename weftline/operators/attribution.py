"""Roots: order, labels, nesting, and attributing paths to the deepest root that contains them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import paths

UNKNOWN_LABEL = "?"


def normalize_roots(roots: DataFrame) -> DataFrame:
    """(ord, root, base_name, label) of (ord, root): the first of equal roots stays, in order.

    Labels are base names; equal ones are numbered in order, name#1, name#2. Roots are few (a session's directories), so
    their windows run in one task.
    """
    first = Window.partitionBy("root").orderBy("ord")
    kept = roots.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("ord", "root", paths.base_name(F.col("root")).alias("base_name"))
    same = Window.partitionBy("base_name")
    numbered = kept.withColumn("n", F.count("*").over(same)).withColumn("k", F.row_number().over(same.orderBy("ord")))
    return numbered.select("ord", "root", "base_name", F.when(F.col("n") == 1, F.col("base_name")).otherwise(F.format_string("%s#%d", "base_name", "k")).alias("label"))


def labels_of(roots: Sequence[str]) -> list[tuple[str, str]]:
    """(root, label) of a few roots that the driver holds, as normalize_roots gives them, without a job."""
    first = list(dict.fromkeys(roots))
    names = [r.rstrip("/").rpartition("/")[2] or r for r in first]
    return [(r, n if names.count(n) == 1 else f"{n}#{names[: k + 1].count(n)}") for k, (r, n) in enumerate(zip(first, names, strict=True))]


def check_roots(roots: DataFrame, known: DataFrame) -> DataFrame:
    """roots, or an error for one that the snapshot known (path, is_dir) does not have as a directory."""
    found = roots.join(known.select(F.col("path").alias("root"), "is_dir"), "root", "left")
    bad = F.raise_error(F.concat(F.lit("not a directory: "), F.col("root"))).cast("string")
    return found.withColumn("root", F.when(F.coalesce("is_dir", F.lit(False)), F.col("root")).otherwise(bad)).drop("is_dir")


def deepest(events: DataFrame, by: Sequence[str], path: str = "abs_path") -> DataFrame:
    """(by.., deepest): the path with the most parts, of equals the last in order."""
    return events.groupBy(*by).agg(F.max_by(path, F.struct(paths.depth(F.col(path)), F.col(path))).alias("deepest"))


def nested_pairs(roots: DataFrame) -> DataFrame:
    """(outer_root, inner_root) of distinct roots where one contains the other, by the equality of an ancestor."""
    inner = roots.select(F.col("root").alias("inner_root"), F.explode(paths.ancestors(F.col("root"))).alias("root"))
    return inner.join(roots.select("root"), "root").where("root <> inner_root").select(F.col("root").alias("outer_root"), "inner_root")


def attribute(events: DataFrame, roots: DataFrame, path: str = "abs_path") -> DataFrame:
    """events with repo_root, repo_label and rel_path of the deepest root that contains the path.

    Paths outside all roots keep a null root, the label "?" and the whole path. Each distinct path is matched once: its
    ancestors are joined by equality with the roots, so the cost does not grow with their number.
    """
    own = events.select(F.col(path).alias("p_")).distinct()
    up = own.select("p_", F.explode(paths.ancestors(F.col("p_"))).alias("root"))
    hit = up.join(roots.select("root", "label"), "root")
    best = hit.groupBy("p_").agg(F.max_by(F.struct("root", "label"), paths.depth(F.col("root"))).alias("best"))
    joined = events.join(best, events[path] == best["p_"], "left")
    root = F.col("best.root")
    return joined.select(*[events[c] for c in events.columns], root.alias("repo_root"), F.coalesce("best.label", F.lit(UNKNOWN_LABEL)).alias("repo_label"), paths.relative(events[path], root).alias("rel_path"))


def attribute_few(events: DataFrame, roots: list[tuple[str, str]], path: str = "abs_path") -> DataFrame:
    """As attribute, for a driver-side list of (root, label): one expression per root, without a join.

    What a stream or a session of a few dozen roots should use: no shuffle, and the plan stays a projection.
    """
    root = F.lit(None).cast("string")
    label = F.lit(UNKNOWN_LABEL)
    for r, name in sorted(roots, key=lambda x: (x[0] != "/") * x[0].count("/")):
        inside = paths.is_under(F.col(path), F.lit(r))
        root, label = F.when(inside, F.lit(r)).otherwise(root), F.when(inside, F.lit(name)).otherwise(label)
    return events.withColumns({"repo_root": root, "repo_label": label}).withColumn("rel_path", paths.relative(F.col(path), F.col("repo_root")))


def attribute_theta(events: DataFrame, roots: DataFrame, path: str = "abs_path", key: str = "event_id") -> DataFrame:
    """The definition as it stands, by a containment join and arg-max; only to test the others against (O(events x roots))."""
    hit = events.join(F.broadcast(roots), paths.is_under(F.col(path), F.col("root")), "left")
    best = hit.groupBy(key).agg(F.max_by(F.struct("root", "label"), F.coalesce(paths.depth(F.col("root")), F.lit(0))).alias("best"))
    return events.join(best, key).select(*events.columns, F.col("best.root").alias("repo_root"), F.coalesce("best.label", F.lit(UNKNOWN_LABEL)).alias("repo_label"), paths.relative(F.col(path), F.col("best.root")).alias("rel_path"))
