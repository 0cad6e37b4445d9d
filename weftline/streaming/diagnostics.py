"""Latest diagnostics of a stream of pushes."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "uri string, push_seq long, diagnostics string"


def latest_stream(pushes: DataFrame) -> DataFrame:
    """Update-mode stream of each file's latest push; pushes: (uri, push_seq, diagnostics as JSON). An older push never replaces a newer one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, text = state.get if state.exists else (-1, "[]")
        for frame in frames:
            if len(frame):
                seqs = frame["push_seq"].to_numpy("int64")
                k = len(seqs) - 1 - int(seqs[::-1].argmax())  # the last of the newest
                if seqs[k] >= seq:
                    seq, text = int(seqs[k]), frame["diagnostics"].iloc[k]
        state.update((seq, text))
        yield pd.DataFrame({"uri": [key[0]], "push_seq": [seq], "diagnostics": [text]})

    return pushes.groupBy("uri").applyInPandasWithState(run, LATEST, "seq long, diagnostics string", "update", GroupStateTimeout.NoTimeout)


def wait_for(spark: SparkSession, table: str, uri: str, timeout: float = 5.0, newer_than: int = -1, step: float = 0.1) -> list[str]:
    """What the table of pushes has for the file, at once if a push is newer than ``newer_than`` (the newest known before a
    change, say), else after waiting for one up to the timeout; then the newest there is, or [].

    The table is asked again after pauses that double from ``step`` to a second, each time by one short job.
    """
    end = time.monotonic() + timeout
    pushes = spark.table(table).where(F.col("uri") == F.lit(uri)).groupBy().agg(F.max_by(F.struct("push_seq", "diagnostics"), "push_seq").alias("p"))
    while True:
        found = pushes.first()["p"]
        if (found is not None and found["push_seq"] > newer_than) or time.monotonic() >= end:
            return [] if found is None else [found["diagnostics"]]
        time.sleep(min(step, max(0.0, end - time.monotonic())))
        step = min(1.0, 2 * step)
