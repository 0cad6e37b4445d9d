"""Sinks that send a batch's rows once: what was sent is kept by query, batch and chunk, and a replay goes on behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import stages
from weftline.operators import changes

NUMBERS = {"Created": 1, "Changed": 2, "Deleted": 3}


class SentLog:
    """Marks in a shared folder: one empty file for each chunk that was sent."""

    def __init__(self, spark: SparkSession, folder: str, query: str):
        self.spark, self.root = spark, f"{folder.rstrip('/')}/{query}"
        self._fs, _ = stages.path_of(spark, self.root)

    def _path(self, name: str):
        return stages.path_of(self.spark, f"{self.root}/{name}")[1]

    def sent(self, batch: int) -> int:
        """How many chunks of the batch were sent, in a row from the first; all of an older batch."""
        if self._fs.exists(self._path(f"{batch}/done")):
            return -1
        n = 0
        while self._fs.exists(self._path(f"{batch}/{n}")):
            n += 1
        return n

    def mark(self, batch: int, chunk: int | str) -> None:
        self._fs.create(self._path(f"{batch}/{chunk}"), True).close()

    def forget_before(self, batch: int) -> None:
        """Drops the marks of batches that cannot be told again."""
        if self._fs.exists(self._path(".")):
            for s in self._fs.listStatus(self._path(".")):
                name = s.getPath().getName()
                if name.isdigit() and int(name) < batch:
                    self._fs.delete(s.getPath(), True)


def send_once(rows: Iterator, batch: int, log: SentLog, send: Callable[[list, str], None], chunk: int = 1000, keep: int = 100) -> int:
    """Sends the rows of a batch in chunks, in order, each with a key (batch/chunk); returns how many rows were sent now.

    A chunk is marked after it was sent, so a failure between the two sends one chunk again, under the same key, by which a
    receiver can tell. Rows must come in the same order each time. Marks of all but the last ``keep`` batches are dropped.
    """
    done = log.sent(batch)
    if done < 0:
        return 0
    rows, n, count = iter(rows), 0, 0
    while part := list(islice(rows, chunk)):
        if n >= done:
            send(part, f"{batch}/{n}")
            log.mark(batch, n)
            count += len(part)
        n += 1
    log.mark(batch, "done")
    log.forget_before(batch - keep)
    return count


def notify_once(send: Callable[[list[tuple[str, int]], str], None], suffixes: Sequence[str], log: SentLog, chunk: int = 1000) -> Callable[[DataFrame, int], None]:
    """A sink (see watch.watch) that hands a batch's translated file events to ``send``, in order, each chunk once whatever is
    replayed, and nothing if none remain."""

    def one(envelope: DataFrame, number: int) -> None:
        events = envelope.select(F.posexplode("events").alias("seq", "e")).select("seq", "e.*")
        rows = changes.translate(events, suffixes).orderBy("seq").toLocalIterator()
        send_once(((r["uri"], NUMBERS[r["type"]]) for r in rows), number, log, send, chunk)

    return one
