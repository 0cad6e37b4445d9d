"""Change events in micro-batches: grouping in time, coalescing, envelopes, routing and translation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from weftline.functions import paths, text
from weftline.stages import Stages

#: A key's events are one file's change in one batch.
PATH_KEY = ("repo_root", "rel_path", "abs_path")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def capped_starts(times: Sequence[int] | np.ndarray, gap: int, cap: int, start: int | None = None, last: int | None = None) -> np.ndarray:
    """For sorted times, the start of the batch that each belongs to: a batch ends after a gap of more than ``gap``, or
    before an event that is ``cap`` or more after its start. start, last: of a batch that is still open.

    A cap makes each batch depend on the one before, so the loop is over batches, never over events.
    """
    t = np.asarray(times, np.int64)
    out = np.empty(len(t), np.int64)
    runs = np.concatenate([[0], np.flatnonzero(np.diff(t) > gap) + 1, [len(t)]])
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        i = a
        if a == 0 and b and last is not None and t[0] - last <= gap:
            i = int(np.searchsorted(t[:b], start + cap, "left"))
            out[:i] = start
        while i < b:
            j = max(i + 1, a + int(np.searchsorted(t[a:b], t[i] + cap, "left")))
            out[i:j] = t[i]
            i = j
    return out


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _scan_runs(frames: Iterator[pd.DataFrame], owner: str, time: str, gap: int, cap: int, states: Mapping[int, tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """Frames sorted by owner and time with batch_start; only the running batch is kept. states: of owners that go on."""
    name = start = last = None
    for frame in frames:
        if not len(frame):
            continue
        owners, times = frame[owner].to_numpy(np.int64), frame[time].to_numpy(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1, [len(frame)]])
        out = np.empty(len(frame), np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if owners[a] != name:
                name = int(owners[a])
                start, last = states.get(name, (None, None))
            out[a:b] = capped_starts(times[a:b], gap, cap, start, last)
            start, last = int(out[b - 1]), int(times[b - 1])
        yield frame.assign(batch_start=out)


def border_runs(borders: Sequence[Row], gap: int) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Which scan each partition's first run belongs to, and the state that a scan goes on from. borders: of each partition with rows,
    in order, part, the first and last key and time, runs, and batch_start of the last row (null in a first run)."""
    scan_of: dict[int, int] = {}
    states: dict[int, tuple[int, int]] = {}
    before = None
    for b in borders:
        goes_on = before is not None and _same(before["last_key"], b["first_key"]) and b["first_time"] - before["last_time"] <= gap
        if goes_on and before["runs"] == 1:
            scan_of[b["part"]] = scan_of[before["part"]]
        else:
            scan_of[b["part"]] = b["part"]
            if goes_on:
                states[b["part"]] = (before["last_start"], before["last_time"])
        before = b
    return scan_of, states


def capped_batches(events: DataFrame, key: str, time: str, order: str, gap: int, cap: int) -> DataFrame:
    """events with batch_start. A gap of more than ``gap`` ends a batch whatever its cap, so the runs between such gaps are the unit
    of parallel work, not the keys.

    Events are range-partitioned by key and time, so a key with very many spreads over tasks. A task finishes all runs but
    its first, which may have begun in the partition before: what it goes on from is told by one row for each partition, and
    the first runs are scanned again, each with the state at its border; a run over several partitions is one scan, in
    order, that keeps only the running batch. Null keys are one key.
    """
    spark = events.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*events.schema.fields]).add("batch_start", LongType()).add("part_", IntegerType()).add("run_", LongType()).add("at_", LongType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        name = last = None
        number, at = -1, 0

        def numbered() -> Iterator[pd.DataFrame]:
            nonlocal name, last, number, at
            for frame in frames:
                if not len(frame):
                    continue
                keys, times = frame[key], frame[time].to_numpy(np.int64)
                new = np.ones(len(frame), bool)
                other = (keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())).to_numpy(bool)
                new[1:] = other[1:] | (np.diff(times) > gap)
                new[0] = number < 0 or not _same(keys.iloc[0], name) or times[0] - last > gap
                runs = number + np.cumsum(new)
                name, last, number = keys.iloc[-1], int(times[-1]), int(runs[-1])
                yield frame.assign(part_=np.int32(part), run_=runs, at_=at + np.arange(len(frame)))
                at += len(frame)

        for frame in _scan_runs(numbered(), "run_", time, gap, cap, {}):
            starts = frame["batch_start"].where(frame["run_"] > 0).astype("Int64")
            yield frame.assign(batch_start=starts)[schema.names]

    dealt = events.repartitionByRange(parts, key, time, order).sortWithinPartitions(key, time, order)
    found = Stages(spark).put(dealt.mapInPandas(run, schema))
    edge = F.struct(F.col(key).alias("k"), F.col(time).alias("t"), F.col("batch_start").alias("s"))
    by_part = found.groupBy("part_").agg(F.min_by(edge, "at_").alias("a"), F.max_by(edge, "at_").alias("z"), (F.max("run_") + 1).alias("runs"))
    # one row for each partition
    borders = by_part.select(F.col("part_").alias("part"), F.col("a.k").alias("first_key"), F.col("a.t").alias("first_time"), F.col("z.k").alias("last_key"), F.col("z.t").alias("last_time"), F.col("z.s").alias("last_start"), "runs").orderBy("part_").collect()
    scan_of, states = border_runs(borders, gap)
    place = spark.createDataFrame(list(scan_of.items()), "part_ int, scan_ int")
    first = found.where("run_ = 0").join(F.broadcast(place), "part_").withColumn("scan_", F.col("scan_").cast("long"))
    columns = [*events.columns, "batch_start"]
    again = StructType([*first.drop("batch_start").schema.fields]).add("batch_start", LongType())
    redone = first.drop("batch_start").repartition(parts, "scan_").sortWithinPartitions("scan_", time, order).mapInPandas(lambda frames: _scan_runs(frames, "scan_", time, gap, cap, states), again)
    return found.where("run_ > 0").select(*columns).unionByName(redone.select(*columns))


def coalesce(events: DataFrame, batch: Sequence[str] = (), seq: str = "seq", exists: str = "exists_now") -> DataFrame:
    """One final change for each batch and path: (batch.., repo_root, rel_path, abs_path, repo_label, change, seq).

    deleted without added is deleted, added without deleted is added, both give modified if the path exists now and deleted
    if not, else modified. seq is the first seen, by which results are ordered; the label is that of the last event.
    """
    seen = lambda c: F.bool_or(F.col("change") == c)
    rows = events.groupBy(*batch, *PATH_KEY).agg(
        seen("added").alias("a"), seen("deleted").alias("d"), F.bool_or(F.coalesce(F.col(exists), F.lit(False))).alias("e"), F.min(seq).alias("seq"), F.max_by("repo_label", seq).alias("repo_label")
    )
    final = F.when(F.col("d") & ~F.col("a"), "deleted").when(F.col("a") & ~F.col("d"), "added").when(F.col("a") & F.col("d") & ~F.col("e"), "deleted").otherwise("modified")
    return rows.select(*batch, *PATH_KEY, "repo_label", final.alias("change"), "seq")


def flags(events: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Which changes each batch and path has seen, as a text of A, D and M."""
    letter = lambda c, s: F.when(F.bool_or(F.col("change") == c), s).otherwise("")
    return events.groupBy(*batch, *PATH_KEY).agg(F.concat(letter("added", "A"), letter("deleted", "D"), letter("modified", "M")).alias("seen"))


def with_existence(events: DataFrame, snapshot: DataFrame, path: str = "abs_path") -> DataFrame:
    """events with exists_now: whether the snapshot (path) has their path."""
    there = snapshot.select(F.col("path").alias("p_")).distinct().withColumn("there_", F.lit(True))
    return events.join(there, events[path] == there["p_"], "left").withColumn("exists_now", F.coalesce("there_", F.lit(False))).drop("p_", "there_")


def first_and_last(events: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """(key.., first_seq, last_change): where each key was first seen, and its last change."""
    return events.groupBy(*key).agg(F.min(seq).alias("first_seq"), F.max_by("change", seq).alias("last_change"))


def raw_counts(events: DataFrame, batch: Sequence[str]) -> DataFrame:
    return events.groupBy(*batch).agg(F.count("*").alias("raw"))


def paths_without(events: DataFrame, change: str, batch: Sequence[str] = ()) -> DataFrame:
    """(batch.., abs_path) of what had other changes but not this one."""
    seen = events.groupBy(*batch, "abs_path").agg(F.bool_or(F.col("change") == change).alias("hit_"))
    return seen.where("not hit_").select(*batch, "abs_path")


def paths_by_root(events: DataFrame) -> DataFrame:
    """(repo_root, rel_paths): each root's distinct paths in order."""
    return events.groupBy("repo_root").agg(F.array_sort(F.collect_set("rel_path")).alias("rel_paths"))


def merged(streams: Sequence[DataFrame]) -> DataFrame:
    """The rows of all streams of changes, by column names."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def headers(raw: DataFrame, final: DataFrame, batch: Sequence[str]) -> DataFrame:
    """(batch.., raw, filtered): the changes given as raw (those that the ignore rules leave) and events after coalescing; batches that lost all events stay with 0."""
    n = raw_counts(raw, batch)
    kept = final.groupBy(*batch).agg(F.count("*").alias("filtered"))
    return n.join(kept, list(batch), "left").withColumn("filtered", F.coalesce("filtered", F.lit(0).cast("long")))


def envelopes(head: DataFrame, final: DataFrame, batch: Sequence[str], warnings: DataFrame | None = None) -> DataFrame:
    """head with events (in order of seq) and warnings as arrays; empty batches have empty arrays."""
    event = F.struct("seq", "change", "abs_path", "repo_root", "repo_label", "rel_path")
    bare = lambda x: F.struct(*[x[c].alias(c) for c in ("change", "abs_path", "repo_root", "repo_label", "rel_path")])
    lists = final.groupBy(*batch).agg(F.transform(F.array_sort(F.collect_list(event)), bare).alias("events"))
    out = head.join(lists, list(batch), "left")
    out = out.withColumn("events", F.coalesce("events", F.array().cast(lists.schema["events"].dataType)))
    if warnings is None:
        return out.withColumn("warnings", F.array().cast("array<string>"))
    listed = warnings.groupBy(*batch).agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    return out.join(listed, list(batch), "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def by_suffix(events: DataFrame, suffixes: Sequence[str], path: str = "abs_path") -> DataFrame:
    """events whose path ends with any of the suffixes, as plain text and in its case; all of them for no suffixes."""
    if not suffixes:
        return events
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col(path).endswith(s)
    return events.where(ends)


def route(events: DataFrame, languages: DataFrame, path: str = "abs_path") -> DataFrame:
    """events once for each language (name, suffixes) that takes them; a language without suffixes takes all.

    Languages are configuration (a handful), so their table is broadcast.
    """
    takes = (F.size("suffixes") == 0) | F.exists("suffixes", lambda s: F.endswith(F.col(path), s))
    return events.join(F.broadcast(languages.select(F.col("name").alias("language"), "suffixes")), takes).drop("suffixes")


def translate(events: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(seq, uri, type) file events of those that the suffixes take, in the order of seq where sorted by it."""
    return by_suffix(events, suffixes).select("seq", paths.to_uri(F.col("abs_path")).alias("uri"), text.file_event_type(F.col("change")).alias("type"))


def chunks(events: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """events with chunk: the number, from 0, of the group of ``size`` in their key's order."""
    return events.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def printed(events: DataFrame) -> DataFrame:
    """Lines of a console report, sorted by label, path and change."""
    line = F.concat(text.change_label(F.col("change")), F.lit("  ["), F.col("repo_label"), F.lit("] "), F.col("rel_path"))
    return events.orderBy("repo_label", "rel_path", text.change_number(F.col("change"))).select("repo_label", "rel_path", "change", line.alias("line"))
