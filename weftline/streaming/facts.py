"""Fact tables that follow file changes: a batch's changed files are parsed again and only the partitions they lie in are replaced.

A store is a folder with one table of files (uri, seq, deleted) and any fact tables with a uri. All are partitioned by a hash of
the uri; a batch writes the touched partitions anew under its own version, and one small commit file then says which version of
each partition counts. Readers see the last commit, whole batches only. A commit also remembers the last batch number of each
source, so a batch that is replayed after a failure changes nothing, and a deleted file stays as a row of the table of
files, so that an older change that comes late cannot bring it back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

from weftline import stages

FILES = "uri string, seq long, deleted boolean"

#: Makes a table's rows (with a uri) from the changed files (uri, text) that are there.
Parse = Callable[[DataFrame], DataFrame]


class FactStore:
    """tables: name -> (schema of the rows, how they are made). ``buckets`` is fixed for a folder's life; a bucket is what a batch
    rewrites at least, so it should be large enough for a file or a few and small next to the whole."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, Parse]], buckets: int = 64):
        if "files" in tables:
            raise ValueError("files is the store's own table")
        self.spark, self.folder, self.tables, self.buckets = spark, folder.rstrip("/"), tables, buckets
        self._fs, _ = stages.path_of(spark, self.folder)

    def _path(self, name: str):
        return stages.path_of(self.spark, f"{self.folder}/{name}")[1]

    def _numbers(self, name: str) -> list[int]:
        """The numbers that name entries of a folder: commits, or versions (v=..)."""
        if not self._fs.exists(self._path(name)):
            return []
        found = (s.getPath().getName().removeprefix("v=") for s in self._fs.listStatus(self._path(name)))
        return sorted(int(n) for n in found if n.isdigit())

    def commit(self, number: int | None = None) -> dict:
        """A commit (the last one for None): its number, the version of each bucket, and each source's last batch."""
        numbers = self._numbers("commits")
        if not numbers:
            return {"number": -1, "versions": {}, "sources": {}}
        number = numbers[-1] if number is None else number
        text = self.spark.read.text(f"{self.folder}/commits/{number}", wholetext=True).first()[0]
        return json.loads(text)

    def _write_commit(self, found: dict) -> None:
        """By renaming a finished file, which fails if another writer has made this commit."""
        part = self._path(f"commits-{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        self._fs.mkdirs(self._path("commits"))
        target = self._path(f"commits/{found['number']}")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise RuntimeError(f"commit {found['number']} was made by another writer")

    def schema(self, table: str) -> StructType:
        return self.spark.createDataFrame([], FILES if table == "files" else self.tables[table][0]).schema

    def _bucket(self, uri: str | Column = "uri") -> Column:
        return F.pmod(F.xxhash64(uri), F.lit(self.buckets)).cast("int")

    def _rows(self, table: str, versions: dict[int, int]) -> DataFrame:
        """Rows of these buckets in these versions: a filter on the two partition columns, so nothing else is read."""
        schema = self.schema(table)
        if not versions or not self._fs.exists(self._path(table)):
            return self.spark.createDataFrame([], schema)
        by: dict[int, list[int]] = {}
        for bucket, version in versions.items():
            by.setdefault(version, []).append(bucket)
        wanted = F.lit(False)
        for version, found in by.items():
            wanted = wanted | ((F.col("v") == version) & F.col("bucket").isin(found))
        whole = StructType([*schema.fields]).add("v", LongType()).add("bucket", IntegerType())
        return self.spark.read.schema(whole).parquet(f"{self.folder}/{table}").where(wanted).select(*schema.names)

    def facts(self, table: str) -> DataFrame:
        """The table as of the last commit; ``files`` has the deleted ones too."""
        return self._rows(table, {int(b): v for b, v in self.commit()["versions"].items()})

    def apply(self, changes: DataFrame, number: int, source: str = "") -> bool:
        """Brings the tables up to a batch of changes (uri, seq, deleted, text); False if the source's batch was applied before.

        Of several changes of a file that with the largest seq counts, and none that is not newer than the one known. A null text
        is that of a file that is gone. An empty batch is committed as well.
        """
        last = self.commit()
        if number <= last["sources"].get(source, -1):
            return False
        version = last["number"] + 1
        gone = F.col("deleted") | F.col("text").isNull()
        newest = changes.where("uri is not null").groupBy("uri").agg(F.max("seq").alias("seq"), F.max_by(F.struct(gone.alias("deleted"), "text"), F.struct("seq", ~gone, "text")).alias("c"))
        with stages.Stages(self.spark) as held:
            newest = held.put(newest.select("uri", "seq", "c.deleted", "c.text", self._bucket().alias("bucket")))
            touched = {r["bucket"] for r in newest.select("bucket").distinct().collect()}
            before = {int(b): v for b, v in last["versions"].items() if int(b) in touched}
            known = self._rows("files", before)
            later = newest.join(known.select("uri", F.col("seq").alias("seq_")), "uri", "left").where("seq_ is null or seq > seq_")
            fresh = held.put(later.select("uri", "seq", "deleted", "text"))
            names = fresh.select("uri")
            self._replace("files", known.join(names, "uri", "left_anti").unionByName(fresh.select("uri", "seq", "deleted")), version)
            there = fresh.where("not deleted").select("uri", "text")
            for table, (_, parse) in self.tables.items():
                kept = self._rows(table, before).join(names, "uri", "left_anti")
                self._replace(table, kept.unionByName(parse(there).select(*kept.columns)), version)
        versions = last["versions"] | {str(b): version for b in sorted(touched)}
        self._write_commit({"number": version, "versions": versions, "sources": last["sources"] | {source: number}})
        return True

    def _replace(self, table: str, rows: DataFrame, version: int) -> None:
        """Writes a version's buckets; what a failed attempt left of it goes. Large buckets are split among tasks."""
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/v={version}")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the bucket versions that none of the last ``keep`` commits names, and older commits; returns how many folders went."""
        numbers = self._numbers("commits")
        named = {(int(b), v) for n in numbers[-keep:] for b, v in self.commit(n)["versions"].items()}
        newest, gone = max((v for _, v in named), default=-1), 0
        for table in ("files", *self.tables):
            for version in self._numbers(table):
                if version > newest:  # of a batch that is under way
                    continue
                for s in self._fs.listStatus(self._path(f"{table}/v={version}")):
                    name = s.getPath().getName()
                    if name.startswith("bucket=") and (int(name.removeprefix("bucket=")), version) not in named:
                        self._fs.delete(s.getPath(), True)
                        gone += 1
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"commits/{n}"), False)
        return gone


def follow(changes: DataFrame, store: FactStore, checkpoint: str, source: str = "", trigger: dict | None = None) -> StreamingQuery:
    """Applies a stream of changes (uri, seq, deleted, text) to the store, batch by batch."""
    return changes.writeStream.foreachBatch(lambda batch, number: store.apply(batch, number, source) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_texts(changes: DataFrame, path: str = "abs_path", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(uri, seq, deleted, text) of changes (seq, change and a path) with the files' texts as they are now, read where the rows are, by
    tasks that see the files. A file that cannot be read as UTF-8 has no symbols (an empty text); one that is gone is deleted."""
    from weftline.functions import paths

    rows = changes.select(paths.to_uri(F.col(path)).alias("uri"), "seq", (F.col("change") == "deleted").alias("deleted"), F.col(path).alias("path_"))
    if suffixes:
        rows = rows.where(" or ".join(f"endswith(path_, '{s}')" for s in suffixes))

    def read(frames):
        for frame in frames:
            texts = []
            for name, deleted in zip(frame["path_"], frame["deleted"], strict=True):
                try:
                    with open(name, "rb") as f:
                        texts.append(None if deleted else f.read().decode())
                except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                    texts.append(None)
                except UnicodeDecodeError:
                    texts.append("")
            yield frame.drop(columns="path_").assign(text=texts)

    return rows.mapInPandas(read, "uri string, seq long, deleted boolean, text string")
