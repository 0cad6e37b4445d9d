"""Changes of large trees as a stream: offsets are version numbers, listings are made and kept in shards by tasks.

A version of the tree is one sorted table for each shard of its folders, in a store that driver and executors share. A trigger asks
for the next version; each shard's task lists its folders, keeps the listing under the version's number, and tells how it
differs from the version before. A listing that is kept is never made again, so a batch that is told once more after a
failure has the same rows in the same order. The driver holds two numbers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LISTING = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())])
#: What stands for time and size of a folder: a folder is only added or deleted.
FOLDER = (-1, -1)
#: Folder levels below a root that decide the shard.
DEPTH = 2


def shard_of(folder: str, shards: int) -> int:
    return zlib.crc32(folder.encode()) % shards


def list_shard(roots: list[str], shard: int, shards: int, ignore_denied: bool = False) -> list[tuple[str, int, int]]:
    """(path, mtime in ns, size) of the files and folders of one shard, sorted by path: what lies in folders whose first DEPTH levels
    below the root hash to it. Only the folders above that level are listed by every shard. Links are not followed into folders."""
    out: list[tuple[str, int, int]] = []
    for root in roots:
        left = [("", 0)]
        while left:
            folder, level = left.pop()
            mine = level > DEPTH or shard_of(folder, shards) == shard
            if level == DEPTH and not mine:
                continue
            try:
                entries = list(os.scandir(os.path.join(root, folder) if folder else root))
            except FileNotFoundError:
                continue
            except PermissionError:
                if ignore_denied:
                    continue
                raise
            for e in entries:
                below = f"{folder}/{e.name}" if folder else e.name
                try:
                    if e.is_dir(follow_symlinks=False):
                        left.append((below, level + 1))
                        if mine:
                            out.append((e.path, *FOLDER))
                    elif mine:
                        st = e.stat()
                        out.append((e.path, st.st_mtime_ns, st.st_size))
                except FileNotFoundError:
                    continue
    return sorted(out)


def merged(old: Iterator[tuple], new: Iterator[tuple]) -> Iterator[tuple[str, str, bool, bool]]:
    """(change, path, exists_now, is_dir) of two listings that are sorted by path, side by side."""
    a, b = next(old, None), next(new, None)
    while a is not None or b is not None:
        if b is None or (a is not None and a[0] < b[0]):
            yield "deleted", a[0], False, a[1:] == FOLDER
            a = next(old, None)
        elif a is None or b[0] < a[0]:
            yield "added", b[0], True, b[1:] == FOLDER
            b = next(new, None)
        else:
            if a[1:] != b[1:]:
                yield "modified", b[0], True, b[1:] == FOLDER
            a, b = next(old, None), next(new, None)


class Store:
    """Listings of versions and shards in a folder that driver and executors reach by one address."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)

    def _path(self, version: int, shard: int) -> str:
        return f"{self.root}/v={version}/{shard}.parquet"

    def versions(self) -> list[int]:
        if self.fs.get_file_info(self.root).type != fs.FileType.Directory:
            return []
        names = (i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.root)))
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def begin(self, version: int) -> None:
        self.fs.create_dir(f"{self.root}/v={version}", recursive=True)

    def has(self, version: int, shard: int) -> bool:
        return self.fs.get_file_info(self._path(version, shard)).type == fs.FileType.File

    def keep(self, version: int, shard: int, rows: list[tuple]) -> None:
        """By renaming a finished file. If two attempts of a task race, the later one's file stands, and both have told a true state."""
        self.begin(version)
        part = f"{self._path(version, shard)}.{os.getpid()}-{os.urandom(4).hex()}.part"
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        with self.fs.open_output_stream(part) as out:
            pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, LISTING, strict=True)], schema=LISTING), out)
        self.fs.move(part, self._path(version, shard))

    def rows(self, version: int, shard: int) -> Iterator[tuple]:
        """The kept rows, a batch at a time."""
        with self.fs.open_input_file(self._path(version, shard)) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def drop_before(self, version: int) -> None:
        for v in self.versions():
            if v < version:
                self.fs.delete_dir(f"{self.root}/v={v}")


@dataclass
class Shard(InputPartition):
    number: int
    start: int
    end: int


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [r for r in options["roots"].split(os.pathsep) if r]
        self.store = options["store"]
        self.shards = int(options.get("shards", "16"))
        self.existing = options.get("existing", "false") == "true"
        self.ignore_denied = options.get("ignorePermissionDenied", "false") == "true"
        self.told = 0

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self, *_) -> dict:
        """The next version, above any that was begun before a restart."""
        store = Store(self.store)
        self.told = max([self.told, *store.versions()]) + 1
        store.begin(self.told)
        return {"version": self.told}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(k, start["version"], end["version"]) for k in range(self.shards)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        store, k = Store(self.store), partition.number
        if not store.has(partition.end, k):
            store.keep(partition.end, k, list_shard(self.roots, k, self.shards, self.ignore_denied))
        if partition.start > 0:
            before = store.rows(partition.start, k)
        else:  # the first version is what changes are told from, or all of it is told as added
            before = iter(()) if self.existing else store.rows(partition.end, k)
        for n, row in enumerate(merged(before, store.rows(partition.end, k))):
            yield (*row, (k << 40) + n)

    def commit(self, end: dict) -> None:
        """Spark may tell the last batch again, so the version before it stays."""
        Store(self.store).drop_before(end["version"] - 1)


class TreeSource(DataSource):
    """readStream.format("tree"): (change, path, exists_now, is_dir, pos) rows of roots that all executors see. Options: roots (joined
    by the path separator), store (an address of a shared folder), shards, existing (tell what is there at first as added),
    ignorePermissionDenied. pos orders a batch's rows, the same each time that it is told."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "change string, path string, exists_now boolean, is_dir boolean, pos long"

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)
