"""Ignore files of whole trees as a source of rules: every folder's own file, and the excludes that come before them all."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import ignore, ignoreindex

FILE_NAME = ".gitignore"
FILE = "repo_root string, folder string, text string, excludes boolean"

#: Precedence goes by the file first: all excludes, then ignore files by the depth of their folder; then by the line.
_PART, _DEPTH = 1 << 20, 1 << 40


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a root, which driver and executors reach alike, and its path there."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """Rows (see FILE) of all ignore files below a root, and of its own excludes. The driver lists the root's folder; each folder
    below is walked by a task. (Spark's own readers leave out files whose names begin with a dot.)"""
    root = root.rstrip("/")
    store, base = _file_system(root)
    first = store.get_file_info(fs.FileSelector(base))
    tops = [(None,)] + [(i.base_name,) for i in first if i.type == fs.FileType.Directory and i.base_name != ".git"]

    def read(store: fs.FileSystem, path: str) -> str | None:
        if store.get_file_info(path).type != fs.FileType.File:
            return None
        with store.open_input_stream(path) as f:
            return f.read().decode(errors="replace")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _file_system(root)
        for frame in frames:
            for top in frame["top"]:
                found = []
                if top is None:
                    found = [(root, "", read(store, f"{base}/{FILE_NAME}"), False), (root, "", read(store, f"{base}/.git/info/exclude"), True)]
                    left = []
                else:
                    left = [top]
                while left:  # folder by folder, so that a large tree's listing is never held whole
                    folder = left.pop()
                    for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}")):
                        if info.type == fs.FileType.Directory:
                            left.append(f"{folder}/{info.base_name}")
                        elif info.base_name == FILE_NAME:
                            found.append((root, folder, read(store, info.path), False))
                yield pd.DataFrame([r for r in found if r[2] is not None], columns=["repo_root", "folder", "text", "excludes"])

    return spark.createDataFrame(tops, "top string").repartition(max(1, min(len(tops), 1000))).mapInPandas(walk, FILE)


def rules_of(files: DataFrame, part: str | None = None) -> DataFrame:
    """Rule rows (ignoreindex.RULE) of ignore files (FILE), parsed where they are. A deeper folder's rules come after those above it,
    whatever the order of the files; a null text has no rules. part: the column that numbers the parts, below 2^20, of files that
    are given in several rows of less than 2^20 lines each."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ignoreindex.RULE.split(", ")]
        for frame in frames:
            rows = []
            for root, folder, text, excludes, nth in zip(*(frame[c] for c in ("repo_root", "folder", "text", "excludes", "part_")), strict=True):
                folder = (folder or "").strip("/")
                depth = 0 if excludes else 1 + (folder.count("/") + 1 if folder else 0)
                for (_, line, pattern, negated, dir_only), body in zip(ignore.git_rules(root, text or "", folder), bodies(text or ""), strict=True):
                    rows.append((root, folder, depth * _DEPTH + int(nth) * _PART + line, pattern, negated, dir_only, *ignoreindex.literal_of(body)))
            yield pd.DataFrame(rows, columns=names)

    number = F.lit(0) if part is None else F.col(part)
    return files.select("repo_root", "folder", "text", "excludes", number.cast("long").alias("part_")).mapInPandas(parse, ignoreindex.RULE)


def bodies(text: str) -> list[str]:
    """The globs of the lines that ignore.git_rules makes rules of, in order, without ! in front and slashes at the end."""
    return [body for _, body, _ in ignore.rule_lines(text)]


def ignored(asked: DataFrame, files: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """(repo_root, rel_key) of asked rows that the ignore files of a whole tree leave out (see ignoreindex.ignored)."""
    return ignoreindex.ignored(asked, rules_of(files), tracked)
