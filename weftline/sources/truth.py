"""Ground-truth files, <stem>_tests_gt_<server>.json, as VARIANT, and source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "*_tests_gt_*.json"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc) of all ground-truth files below a folder; doc is the parsed JSON."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN).text(folder)
    return files.select(F.col("_metadata.file_name").alias("file"), F.parse_json("value").alias("doc"))


def of_source(truth: DataFrame, stem: str, server: str) -> DataFrame:
    return truth.where(F.col("file") == f"{stem}_tests_gt_{server}.json")


def symbol_tree(truth: DataFrame, levels: int | None = None) -> DataFrame:
    """(file, level, path, name, kind_category) of the symbols section: children are unnested level by level.

    levels: how deep the trees are known to be, so that no job runs here; None goes on until a level is empty.
    """
    top = truth.select("file", F.lit("").alias("above"), F.try_variant_get("doc", "$.symbols", "variant").alias("items"))
    out, level = None, 0
    while True:
        rows = top.where("items is not null").select("file", "above", F.explode(F.try_variant_get("items", "$", "array<variant>")).alias("s"))
        named = rows.select("file", "above", "s", F.try_variant_get("s", "$.name", "string").alias("name"))
        here = named.select("file", F.lit(level).alias("level"), F.concat("above", "name").alias("path"), "name", F.try_variant_get("s", "$.kind_category", "string").alias("kind_category"))
        out = here if out is None else out.unionByName(here)
        top = named.select("file", F.concat("above", "name", F.lit("/")).alias("above"), F.try_variant_get("s", "$.children", "variant").alias("items"))
        level += 1
        if level == levels or levels is None and top.where(F.size(F.try_variant_get("items", "$", "array<variant>")) > 0).isEmpty():
            return out


def whole_texts(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, text, version): files as they are opened, byte for byte in UTF-8, with version 0."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(folder).select("path", F.decode("content", "UTF-8").alias("text"), F.lit(0).alias("version"))
