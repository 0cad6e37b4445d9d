"""Expressions for labels, lists in text, results of queries and positions in source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.model import CHANGES, FILE_EVENT_TYPES, LANGUAGE_IDS


def change_number(change: Column) -> Column:
    """1, 2, 3 for added, modified, deleted; an error for anything else."""
    out = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(change, F.lit("null")))).cast("int")
    for name in reversed(CHANGES):
        out = F.when(change == name, CHANGES.index(name) + 1).otherwise(out)
    return out


def file_event_type(change: Column) -> Column:
    """The protocol's name of a change; an error for anything else."""
    names = {"added": "Created", "modified": "Changed", "deleted": "Deleted"}
    out = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(change, F.lit("null"))))
    return reduce(lambda acc, c: F.when(change == c, F.lit(names[c])).otherwise(acc), FILE_EVENT_TYPES, out)


def change_label(change: Column) -> Column:
    """Upper case, padded to eight characters and never cut."""
    return F.format_string("%-8s", F.upper(change))


def time_label(ts: Column) -> Column:
    """A timestamp to the millisecond, cut rather than rounded."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def last_match(text: Column, pattern: str) -> Column:
    """The last match of a regular expression, or null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def known(value: Column, values: tuple[str, ...], what: str) -> Column:
    """The value itself; an error for any other than these."""
    return F.when(value.isin(*values), value).otherwise(F.raise_error(f"unknown {what}").cast("string"))


def format_tag(name: Column, number: Column) -> Column:
    """name#number."""
    return F.format_string("%s#%d", name, number)


def position(text: Column, part: str) -> Column:
    """Where the part first stands, from 0; -1 where it does not."""
    return F.instr(text, part) - 1


def number_of(name: Column, numbers: dict[str, int], other: int = 0) -> Column:
    """The name's number, or ``other``."""
    table = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(other))


def json_int(text: Column, path: str) -> Column:
    """An integer in a JSON text; null where it is not there."""
    return F.try_variant_get(F.parse_json(text), path, "int")


def split_list(text: Column) -> Column:
    """Comma-separated parts, trimmed, without empty ones; an empty array for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def language_kind(name: Column) -> Column:
    """The language's id in lower case; an error that lists five valid ids for unknown ones."""
    low = F.lower(name)
    return F.when(low.isin(*LANGUAGE_IDS), low).otherwise(F.raise_error(F.concat(F.lit("unknown language "), name, F.lit(f"; valid ids include {', '.join(LANGUAGE_IDS[:5])}"))))


def kind_name(symbols: DataFrame, kinds: DataFrame) -> DataFrame:
    """symbols with kind_name, Kind(n) for kinds outside the table (26 rows, so it is broadcast)."""
    named = symbols.join(F.broadcast(kinds), "kind", "left")
    return named.withColumn("kind_name", F.coalesce("kind_name", F.concat(F.lit("Kind("), F.col("kind"), F.lit(")"))))


def location_uri(target_uri: Column, uri: Column, other: Column) -> Column:
    """The place that a location or a link names: the link's target first."""
    return F.coalesce(target_uri, uri, other)


def hover_text(hover: Column) -> Column:
    """Text of a hover result (VARIANT): its contents' value, else the contents themselves, else empty."""
    return F.coalesce(F.try_variant_get(hover, "$.contents.value", "string"), F.try_variant_get(hover, "$.contents", "string"), F.lit(""))


def supports(capabilities: Column, name: Column | str) -> Column:
    """Whether a server's map of capabilities has this one as true; false for a null map (before the handshake)."""
    key = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(capabilities, key), F.lit(False))


def source_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with its number from 0; other columns stay. Line ends are \\n or \\r\\n."""
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "code"))


#: What a marker's position may point at, first choice first: a definition's, a class's, a call's or any name.
_NAME = r"[A-Za-z_]\w*"
_TOKENS = ((r"\b(?:def|function)\s+", _NAME, ""), (r"\bclass\s+", _NAME, ""), (r"\b", _NAME, r"\s*\("), (r"\b", _NAME, r"\b"))


def markers(lines: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    """(by.., name, line, char) of marker comments in source_lines: the position is that of the last name before the
    comment in the first pattern that has one, else of the comment. The last of equal names in a file wins."""
    at = F.instr("code", prefix) - 1
    code = F.substr(F.col("code"), F.lit(1), at)
    char = at
    for head, name, tail in reversed(_TOKENS):
        # the greedy start leaves the last match; what it and the pattern's head take is the name's position
        char = F.when(code.rlike(head + name + tail), F.length(F.regexp_extract(code, f"^(.*{head}){name}{tail}", 1))).otherwise(char)
    found = lines.where(F.instr("code", prefix) > 0).select(*by, F.trim(F.substr(F.col("code"), at + len(prefix) + 1)).alias("name"), "line", F.when(F.trim(code) == "", at).otherwise(char).alias("char"))
    return found.groupBy(*by, "name").agg(F.max_by(F.struct("line", "char"), "line").alias("p")).select(*by, "name", "p.line", "p.char")


def find_after(lines: DataFrame, marks: DataFrame, pattern: str, by: list[str]) -> DataFrame:
    """marks with the place of the text's first hit on the line that follows the mark; marks without a hit drop out."""
    nxt = lines.withColumn("line", F.col("line") - 1)
    hit = marks.drop("char").join(nxt, [*by, "line"]).where(F.instr("code", pattern) > 0)
    return hit.select(*by, "name", (F.col("line") + 1).alias("line"), (F.instr("code", pattern) - 1).alias("char"))
