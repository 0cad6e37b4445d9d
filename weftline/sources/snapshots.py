"""Change detection: two listings of a tree compared, in batch or as a polling stream."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from weftline.functions import paths
from weftline.model import WatchConfig


def snapshot(spark: SparkSession, root: str, folders: bool = False) -> DataFrame:
    """(path, mtime, size) of all files below a root in any file system that Spark lists; contents are not read.

    folders: also the folders below the root that hold files at any depth, with a null time and size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    if not folders:
        return out
    base = "/" + root.removeprefix("file:").strip("/")
    holders = out.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), F.col("path").alias("file")).where(F.col("path") != F.col("file")).select("path").distinct()
    below = holders.where(paths.is_under(F.col("path"), F.lit(base)) & (F.col("path") != base))
    return out.unionByName(below.select("path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("long").alias("size")))


def diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(change, path): added, deleted, or modified where time or size differ; one full outer join by path."""
    old = before.select("path", F.struct("mtime", "size").alias("old"))
    new = now.select("path", F.struct("mtime", "size").alias("new"))
    both = old.join(new, "path", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(change_of(F.col("old"), F.col("new")).alias("change"), "path")


def change_of(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "deleted").otherwise("modified")


#: What stands for time and size of a folder: a folder is only added or deleted.
FOLDER = [-1, -1]


def list_files(roots: Sequence[str], recursive: bool = True, ignore_denied: bool = False) -> dict[str, list[int]]:
    """path -> [mtime in ns, size] of all files and folders below local roots."""

    def denied(error: OSError) -> None:
        if not (ignore_denied and isinstance(error, PermissionError)):
            raise error

    out: dict[str, list[int]] = {}
    for root in roots:
        for folder, dirs, names in os.walk(root, onerror=denied):
            for name in names:
                path = os.path.join(folder, name)
                try:
                    st = os.stat(path)
                except FileNotFoundError:
                    continue
                out[path] = [st.st_mtime_ns, st.st_size]
            for name in dirs:
                out[os.path.join(folder, name)] = FOLDER
            if not recursive:
                dirs.clear()
    return out


def changes_between(old: dict, new: dict) -> list[tuple]:
    """(change, path, exists_now, is_dir) of two listings, sorted by path."""
    out = []
    for p in sorted(old.keys() | new.keys()):
        if old.get(p) != new.get(p):
            out.append(("added" if p not in old else "deleted" if p not in new else "modified", p, p in new, (new.get(p) or old.get(p)) == FOLDER))
    return out


class WorkspaceReader(SimpleDataSourceStreamReader):
    """Offsets are listings, so what lies between two of them can be told again after a restart.

    Once something has changed, the roots are listed again every stepMs until a listing brings nothing new or debounceMs
    have passed: what was told in between is one batch, and exists_now is by its last listing. After a restart a
    batch is told by its first and last listing alone.
    """

    def __init__(self, options: dict[str, str]):
        self.roots = [r for r in options["roots"].split(os.pathsep) if r]
        self.recursive = options.get("recursive", "true") == "true"
        self.ignore_denied = options.get("ignorePermissionDenied", "false") == "true"
        self.debounce = int(options.get("debounceMs", WatchConfig().debounce_ms)) / 1000
        self.step = int(options.get("stepMs", WatchConfig().step_ms)) / 1000

    def _list(self) -> dict:
        return list_files(self.roots, self.recursive, self.ignore_denied)

    @staticmethod
    def _offset(files: dict) -> dict:
        return {"files": json.dumps(files, sort_keys=True)}

    def initialOffset(self) -> dict:
        return self._offset(self._list())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = json.loads(start["files"]), self._list()
        rows = changes_between(before, now)
        end = time.monotonic() + self.debounce
        while rows and time.monotonic() < end:
            time.sleep(max(0.0, min(self.step, end - time.monotonic())))
            before, now = now, self._list()
            more = changes_between(before, now)
            if not more:
                break
            rows += more
        return iter([(change, p, p in now, is_dir, k) for k, (change, p, _, is_dir) in enumerate(rows)]), self._offset(now)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(*row, k) for k, row in enumerate(changes_between(json.loads(start["files"]), json.loads(end["files"])))])


class WorkspaceSource(DataSource):
    """readStream.format("workspace"): (change, path, exists_now, is_dir, pos) rows of local roots, an option joined by the path separator.

    For workspaces of up to some hundred thousand files, as each offset is a listing; larger trees have sources.shards.
    """

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "change string, path string, exists_now boolean, is_dir boolean, pos long"

    def simpleStreamReader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options)
