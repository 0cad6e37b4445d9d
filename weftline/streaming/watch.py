"""Change streams: capped session batches with state, and the watch pipeline as a foreachBatch sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from weftline.model import WatchConfig
from weftline.operators import attribution, changes, ignore


def capped_batches_stream(events: DataFrame, key: str, time: str, order: str, gap: int, cap: int, expire_ms: int | None = None) -> DataFrame:
    """The streaming twin of changes.capped_batches: events with batch_start; the state of a key is its batch's start and last time.

    A key's events must come in order across micro-batches; within one they are sorted here. expire_ms: a key that has been
    quiet for so long, by the clock, is forgotten (its next event starts a batch); None keeps two numbers for each key.
    """
    schema = StructType([*events.schema.fields]).add("batch_start", "long")

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, last = state.get if state.exists else (None, None)
        frame = pd.concat(list(frames)).sort_values([time, order])  # a key's rows of one micro-batch
        times = frame[time].to_numpy("int64")
        out = changes.capped_starts(times, gap, cap, start, last)
        state.update((int(out[-1]), int(times[-1])))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        yield frame.assign(batch_start=out)

    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy(key).applyInPandasWithState(run, schema, "start long, last long", "append", timeout)


def prepare(raw: DataFrame, roots: Sequence[tuple[str, str]], cfg: WatchConfig, batch: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The whole path of raw changes (seq, change, path, exists_now, is_dir, and batch columns): attributed, filtered by rules and git, coalesced.

    Returns the final events and warnings (repo_root, warning). The same plan serves tables and micro-batches.
    """
    rules = ignore.rules_of(cfg)
    events = ignore.apply_rules(raw.withColumnRenamed("path", "abs_path"), rules)
    events = attribution.attribute_few(events, list(roots))
    events, warnings = ignore.git_filter(events, [r for r, _ in roots], cfg.gitignore_filter, cfg.git_chunk_size, cfg.git_timeout_s)
    return (changes.coalesce(events, batch) if cfg.coalesce_events else events), warnings


def change_rows(frame: DataFrame) -> DataFrame:
    """A micro-batch's changes (change, path and, where the source tells them, exists_now and is_dir) in the order they came.

    Where the source does not tell, a path exists if its last change is not a deletion, and nothing is a folder. The order is that of
    the source's own positions (pos); one without them is taken in the order of its partitions, which is that of arrival
    only if it has one.
    """
    rows = frame.withColumn("seq", F.col("pos") if "pos" in frame.columns else F.monotonically_increasing_id())
    if "is_dir" not in frame.columns:
        rows = rows.withColumn("is_dir", F.lit(False))
    if "exists_now" not in frame.columns:
        last = rows.groupBy("path").agg((F.max_by("change", "seq") != "deleted").alias("exists_now"))
        rows = rows.join(last, "path")
    return rows.select("seq", "change", "path", "exists_now", "is_dir")


#: As ``every``: what there is now, then end.
NOW = "now"


def watch(stream: DataFrame, roots: Sequence[tuple[str, str]], cfg: WatchConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs change rows (see change_rows) through prepare, one envelope row for each micro-batch in which the ignore rules
    leave a change, into the sink. raw counts what they leave; git's rules and coalescing come after.

    The source gathers a batch (WorkspaceSource by quiet period and longest time) and the trigger interval is how often it is
    asked. The query runs beside the caller, so there is no async twin.
    """
    rules = ignore.rules_of(cfg)

    def one(frame: DataFrame, number: int) -> None:
        spark = frame.sparkSession
        frame = frame.persist()  # a source may tell a batch only once
        raw = ignore.apply_rules(change_rows(frame), rules, "path").withColumn("batch", F.lit(number)).persist()
        if raw.isEmpty():
            raw.unpersist()
            frame.unpersist()
            return
        final, warnings = prepare(raw, roots, cfg, ["batch"])
        final = final.withColumn("batch", F.lit(number))
        head = spark.range(1).select(F.lit(number).alias("batch")).join(raw.groupBy("batch").agg(F.count("*").alias("raw")), "batch", "left").withColumn("raw", F.coalesce("raw", F.lit(0).cast("long")))
        kept = final.groupBy("batch").agg(F.count("*").alias("filtered"))
        head = head.join(kept, "batch", "left").withColumn("filtered", F.coalesce("filtered", F.lit(0).cast("long"))).withColumn("ts", F.localtimestamp())
        try:
            sink(changes.envelopes(head, final, ["batch"], warnings.withColumn("batch", F.lit(number))).select("ts", "raw", "filtered", "events", "warnings"), number)
        finally:
            raw.unpersist()
            frame.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    trigger = {} if every is None else {"availableNow": True} if every == NOW else {"processingTime": every}
    return (writer.trigger(**trigger) if trigger else writer).start()


def notify(send: Callable[[list[tuple[str, int]]], None], suffixes: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A sink that hands a batch's translated file events to ``send``, and nothing if none remain. Batches are bounded by the trigger."""

    def one(envelope: DataFrame, _: int) -> None:
        events = envelope.select(F.posexplode("events").alias("seq", "e")).select("seq", "e.*")
        rows = [(r["uri"], {"Created": 1, "Changed": 2, "Deleted": 3}[r["type"]]) for r in changes.translate(events, suffixes).orderBy("seq").toLocalIterator()]
        if rows:
            send(rows)

    return one


def notify_raw(send: Callable[[list[tuple[str, int]]], None], rows: Sequence[tuple[str, int]]) -> None:
    """File events as they are, past the suffix filter."""
    if rows:
        send(list(rows))


def console(envelope: DataFrame, _: int) -> None:
    """A sink that prints batches, events sorted."""
    for b in envelope.select("ts", "raw", "filtered", "warnings").toLocalIterator():
        ts = b["ts"].strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]
        events = envelope.select(F.explode("events").alias("e")).select("e.*")
        lines = [r["line"] for r in changes.printed(events).toLocalIterator()]
        notes = [f"note: {w}" for w in b["warnings"]]
        print("\n".join([*lines, *notes, f"= {b['filtered']} of {b['raw']} changes at {ts}", ""]), flush=True)


