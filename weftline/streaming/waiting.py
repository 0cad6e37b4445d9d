"""Requests for a file's diagnostics that wait in state: each is answered once, by a push that is new enough or when its time is up.

Pushes and requests are two streams, keyed by file. A key's state is its latest push and the requests under way; a timer of
the clock ends a wait, so nothing polls and no job runs while requests wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "uri string, request_id string, push_seq long, diagnostics string, fresh boolean"
_ROW = ("uri", "kind", "push_seq", "diagnostics", "request_id", "newer_than", "timeout_ms")


class Waiting(StatefulProcessor):
    """latest: the newest push; open: request id -> (newer_than, when its time is up)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "push_seq long, diagnostics string")
        self.open = handle.getMapState("open", "request_id string", "newer_than long, until long")

    def _known(self) -> tuple[int, str] | None:
        return tuple(self.latest.get()) if self.latest.exists() else None

    @staticmethod
    def _rows(uri: str, answers: list[tuple]) -> Iterator[pd.DataFrame]:
        if answers:
            ids, known, fresh = zip(*answers, strict=True)
            seqs = pd.array([None if k is None else k[0] for k in known], "Int64")
            yield pd.DataFrame({"uri": [uri] * len(ids), "request_id": ids, "push_seq": seqs, "diagnostics": [None if k is None else k[1] for k in known], "fresh": fresh})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known, asked = self._known(), []
        before = known
        for frame in rows:
            pushed = frame[frame["kind"] == "push"]
            if len(pushed):
                newest = pushed.loc[pushed["push_seq"].astype("int64").idxmax()]
                if known is None or int(newest["push_seq"]) >= known[0]:
                    known = (int(newest["push_seq"]), newest["diagnostics"])
            for r in frame[frame["kind"] == "request"].itertuples():
                asked.append((r.request_id, int(r.newer_than), int(r.timeout_ms)))
        if known != before:
            self.latest.update(known)
        answers = []
        if known is not None and known != before:
            for (request,), (newer_than, _) in list(self.open.iterator()):
                if known[0] > newer_than:
                    answers.append((request, known, True))
                    self.open.removeKey((request,))
        for request, newer_than, timeout in asked:
            if known is not None and known[0] > newer_than:
                answers.append((request, known, True))
            elif timeout <= 0:
                answers.append((request, known, False))
            elif not self.open.containsKey((request,)):
                self.open.updateValue((request,), (newer_than, now + timeout))
                self.handle.registerTimer(now + timeout)
        yield from self._rows(key[0], answers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        up = expiredTimerInfo.getExpiryTimeInMs()
        known, answers = self._known(), []
        for (request,), (_, until) in list(self.open.iterator()):
            if until <= up:
                answers.append((request, known, False))
                self.open.removeKey((request,))
        yield from self._rows(key[0], answers)

    def close(self) -> None:
        pass


def answers(pushes: DataFrame, requests: DataFrame) -> DataFrame:
    """A stream of ANSWER rows in append mode. pushes: (uri, push_seq, diagnostics); requests: (uri, request_id, newer_than, timeout_ms).

    A request is answered at once if a push with a push_seq over newer_than is known, else by the first batch that brings one
    (fresh), else when timeout_ms have passed, with the newest push there is or nulls (not fresh). A request id that is told
    again while it waits waits once. The trigger's interval is how exact a timer is. Its query is begun by ``start``.
    """
    none = lambda kind: F.lit(None).cast(kind)
    push = pushes.select("uri", F.lit("push").alias("kind"), F.col("push_seq").cast("long"), F.col("diagnostics").cast("string"), none("string").alias("request_id"), none("long").alias("newer_than"), none("long").alias("timeout_ms"))
    ask = requests.select("uri", F.lit("request").alias("kind"), none("long").alias("push_seq"), none("string").alias("diagnostics"), F.col("request_id").cast("string"), F.col("newer_than").cast("long"), F.col("timeout_ms").cast("long"))
    both = push.select(*_ROW).unionByName(ask.select(*_ROW))
    return both.groupBy("uri").transformWithStateInPandas(statefulProcessor=Waiting(), outputStructType=ANSWER, outputMode="append", timeMode="ProcessingTime")


def start(writer: DataStreamWriter, path: str | None = None) -> StreamingQuery:
    """Starts a query over ``answers`` with its state in RocksDB, whatever the session's own provider is: the default one keeps no maps
    and timers beside a value. A query takes its settings as it starts, so the session's are put back at once."""
    conf = writer._spark.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start(path)
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)
