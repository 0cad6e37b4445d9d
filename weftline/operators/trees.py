"""Levels and paths of trees given by parent ids, by pointer doubling.

Each row points to an ancestor and has the names between. A round joins the rows that are still under way with all rows by that
pointer and composes both, so pointers reach twice as far each time: a tree of depth d takes about log2(d) + 1 joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.stages import Stages

#: How a row ends: at a root, at a row whose parent is missing, or never.
ROOT, ORPHAN, CYCLE = "root", "orphan", "cycle"


def _start(rows: DataFrame, id_col: str, parent_col: str, name_col: str) -> DataFrame:
    """(id, up, level, path, top, reached): up is null where the row is settled, be it a root or an orphan."""
    node = rows.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.col(name_col).alias("path"))
    known = node.select(F.col("id").alias("there"))
    there = node.join(known, node["up"] == known["there"], "left")
    lost = F.col("there").isNull()  # of a root too
    reached = F.when(F.col("up").isNull(), ROOT).when(lost, ORPHAN)
    return there.select("id", F.when(~lost, F.col("up")).alias("up"), F.when(lost, 0).otherwise(1).alias("level"), "path", F.when(lost, F.col("id")).alias("top"), reached.alias("reached"))


def _round_of_all(now: DataFrame) -> DataFrame:
    """All rows after one doubling, settled ones as they are: each row is read twice, which counts in a plan without written tables."""
    over = now.select(F.col("id").alias("id_"), *[F.col(c).alias(f"{c}_") for c in ("up", "level", "path", "top", "reached")])
    both = now.join(over, now["up"] == over["id_"], "left")
    met = F.col("id_").isNotNull()
    either = lambda c: F.when(met, F.col(f"{c}_")).otherwise(F.col(c)).alias(c)
    path = F.when(met, F.concat_ws("/", "path_", "path")).otherwise(F.col("path"))
    return both.select("id", either("up"), (F.col("level") + F.coalesce("level_", F.lit(0))).alias("level"), path.alias("path"), either("top"), either("reached"))


def _round(waiting: DataFrame, all_rows: DataFrame) -> DataFrame:
    """The waiting rows after one doubling."""
    over = all_rows.select(F.col("id").alias("id_"), F.col("up").alias("up_"), F.col("level").alias("level_"), F.col("path").alias("path_"), F.col("top").alias("top_"), F.col("reached").alias("reached_"))
    both = waiting.join(over, waiting["up"] == over["id_"])
    return both.select("id", F.col("up_").alias("up"), (F.col("level") + F.col("level_")).alias("level"), F.concat_ws("/", "path_", "path").alias("path"), F.col("top_").alias("top"), F.col("reached_").alias("reached"))


def climb(rows: DataFrame, id_col: str = "symbol_id", parent_col: str = "parent_id", name_col: str = "name", depth: int | None = None) -> DataFrame:
    """(id, level, path, top, reached) of each row: how far below its top it is, the names from there on, and whether the top is a
    root (no parent id) or an orphan (a parent id that no row has). Rows on a cycle or below one have reached ``cycle`` and
    neither level nor path nor top. Ids must be unique; a null id is no row's parent. A null name is left out of paths.

    depth: how deep trees are at most, so that the plan is made without a job; None finds out, with one written table and one count a
    round. Rounds stop when one settles nothing: in a tree of depth 2^k or more some row is settled by round k, so what is
    left then are cycles, and no path grows beyond twice the deepest tree.
    """
    settled = lambda df: df.where("up is null").drop("up")
    under_way = lambda df: df.where("up is not null")
    now = _start(rows, id_col, parent_col, name_col)
    if depth is not None:
        for _ in range(max(0, depth - 1).bit_length()):
            now = _round_of_all(now)
        return settled(now)
    stages = Stages(rows.sparkSession)
    now = stages.put(now)
    done, left = [settled(now)], under_way(now).count()
    while left:
        moved = stages.put(_round(under_way(now), now))
        more = under_way(moved).count()
        done.append(settled(moved))
        if more == left:
            none = F.lit(None)
            done.append(under_way(moved).select("id", none.cast("int").alias("level"), none.cast("string").alias("path"), none.cast(moved.schema["top"].dataType).alias("top"), F.lit(CYCLE).alias("reached")))
            break
        # rows that were settled before are joined by those that point at them
        now, left = settled(now).withColumn("up", none_of(moved, "up")).unionByName(moved), more
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def none_of(df: DataFrame, column: str) -> Column:
    return F.lit(None).cast(df.schema[column].dataType)


def walk(rows: DataFrame, id_col: str = "symbol_id", parent_col: str = "parent_id", name_col: str = "name", depth: int | None = None) -> DataFrame:
    """rows with level, path, top and reached (see climb)."""
    found = climb(rows, id_col, parent_col, name_col, depth).withColumnRenamed("id", "id_")
    return rows.join(found, rows[id_col].eqNullSafe(found["id_"]), "left").drop("id_")


def repeated_ids(rows: DataFrame, id_col: str = "symbol_id") -> DataFrame:
    """(id, n) of ids that stand more than once, which climb must not be given."""
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
