"""Positions in spans over several lines, by equality joins on bins of powers of two.

A span of e lines beyond its first goes to level bits(e), where bins are longer than it, so it lies in two bins at most. A position
lies in one bin a level. Positions are looked up on every STEP-th level alone: all spans of up to 64 lines are met in bins of 64
lines, the longer ones in bins of 4096, and so on. So a position is sent once for each of these levels that there is, mostly once
or twice, for which it is compared with its block's spans, not with its line's alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Levels that are looked up as one.
STEP = 6


def level_of(line: Column, end_line: Column) -> Column:
    extra = (end_line - line).cast("long")
    return F.when(extra <= 0, 0).otherwise(F.length(F.bin(extra)))


def _bin(line: Column, level: Column) -> Column:
    return F.floor(line / F.pow(F.lit(2.0), level)).cast("long")


def binned(spans: DataFrame, step: int = 1) -> DataFrame:
    """spans (uri, line, end_line, ..) once for each bin that they lie in, with level and bin. step: levels are multiples of it, from
    the first. Spans that end before they begin hold no position and are left out, as are those with a null border."""
    level = level_of(F.col("line"), F.col("end_line"))
    if step > 1:
        level = F.greatest(F.lit(1), F.ceil(level / step).cast("int")) * step
    rows = spans.where("end_line >= line").withColumn("level", level)
    first, last = _bin(F.col("line"), F.col("level")), _bin(F.col("end_line"), F.col("level"))
    return rows.withColumn("bin", F.explode(F.sequence(first, last)))


def at(spans: DataFrame, requests: DataFrame) -> DataFrame:
    """Pairs of requests (request_id, uri, line, char) and the spans (uri, line, char_start, end_line, char_end, ..) that hold their
    position: from the first border on, and before the last one. A job tells which levels there are, six at most."""
    cut = binned(spans, STEP)
    levels = sorted(r["level"] for r in cut.select("level").distinct().collect())
    asked = requests.select("request_id", "uri", F.col("line").alias("at_line"), F.col("char").alias("at_char"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    asked = asked.withColumn("bin", _bin(F.col("at_line"), F.col("level")))
    position = F.struct(F.col("at_line").cast("long").alias("l"), F.col("at_char").cast("long").alias("c"))
    begin = F.struct(F.col("line").cast("long").alias("l"), F.col("char_start").cast("long").alias("c"))
    end = F.struct(F.col("end_line").cast("long").alias("l"), F.col("char_end").cast("long").alias("c"))
    return asked.join(cut, ["uri", "level", "bin"]).where((begin <= position) & (position < end)).drop("level", "bin", "at_line", "at_char")


#: Of spans that lie in one another the inner one is less by this: it has fewer lines, or as many and then fewer characters.
def size_of() -> Column:
    return F.struct((F.col("end_line") - F.col("line")).alias("lines"), (F.col("char_end") - F.col("char_start")).alias("chars"), F.col("line"), F.col("char_start"), F.col("symbol_id"))


def innermost(spans: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, symbol_id) of the innermost span at each request's position; of spans of one size the first."""
    least = at(spans, requests).groupBy("request_id").agg(F.min(size_of()).alias("least"))
    return least.select("request_id", F.col("least.symbol_id").alias("symbol_id"))
