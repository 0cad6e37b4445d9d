"""Code-structure queries over fact tables.

symbols(symbol_id, parent_id, uri, name, kind, ord, type_id, signature, doc), occurrences(symbol_id, uri, line, char_start,
char_end, role), calls(caller_id, callee_id), diagnostics(uri, push_seq, severity, message). Requests are tables too
(request_id, uri, line, char), so one plan answers one request or many; a request without an answer has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.model import SEVERITY_ERROR
from weftline.operators import spans, symbolindex, trees


def document_symbols(symbols: DataFrame, uri: str) -> DataFrame:
    """The symbols of one file."""
    return symbols.where(F.col("uri") == uri)


def walk(symbols: DataFrame, levels: int | None = None) -> DataFrame:
    """symbols with level (from 0), path of names, top (the id that the path begins at) and reached: by pointer doubling (trees.climb).

    No symbol is lost: one whose parent is not there is the top of its own tree (reached is ``orphan``), and one on a cycle or below
    has reached ``cycle`` and no path. levels: how deep the trees are at most, so that no job runs here (deeper symbols
    have no path); None finds out. Ids that stand twice are a ValueError if levels is None.
    """
    if levels is None and (twice := trees.repeated_ids(symbols).first()) is not None:
        raise ValueError(f"a symbol id stands {twice['n']} times: {twice['symbol_id']}")
    return trees.walk(symbols, depth=levels)


def without_child(parents: DataFrame, expected: DataFrame) -> DataFrame:
    """Those of the parents (symbol_id) that have none of the expected children (parent_id)."""
    return parents.join(expected.select(F.col("parent_id").alias("symbol_id")), "symbol_id", "left_anti")


def sorted_names(rows: DataFrame, key: str, name: str, into: str) -> DataFrame:
    """Each key's distinct names in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias(into))


def missing_names(expected: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """(key, missing): of each key's expected names those that ``found`` does not have at all, in order."""
    absent = expected.select(key, name).distinct().join(found.select(name).distinct().withColumn("there_", F.lit(True)), name, "left")
    return absent.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("there_").isNull(), F.col(name)))).alias("missing"))


def first_where(rows: DataFrame, usable: Column, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key's rows the first, in the given order, that can be used; keys without such a row have none."""
    rest = [c for c in rows.columns if c not in key]
    first = rows.where(usable).groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_"))
    return first.select(*key, "first_.*")


def distinct_names(symbols: DataFrame) -> DataFrame:
    return symbols.select("name").distinct()


def outline(walked: DataFrame) -> DataFrame:
    """Indented lines of a walk, in order of the path."""
    return walked.select("symbol_id", "path", F.concat(F.repeat(F.lit("  "), F.col("level")), F.col("name")).alias("line"))


def unknown_kinds(walked: DataFrame, kinds: DataFrame, kind: str = "kind_name") -> DataFrame:
    """Symbols whose kind is none of the table's, with their path."""
    return walked.join(F.broadcast(kinds.select(F.col("kind_name").alias(kind))), kind, "left_anti")


def workspace_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols of all files whose name holds the query, in any case and without () at the end."""
    return symbols.where(F.contains(symbolindex.key_of(F.col("name")), F.lit(symbolindex.query_key(query))))


def over_lines(occurrences: DataFrame) -> bool:
    """Whether occurrences say where they end: (.., line, char_start, end_line, char_end), else each is in one line."""
    return "end_line" in occurrences.columns


def _place(occurrences: DataFrame, end: bool = True) -> list[str]:
    """Columns of an occurrence's place; its end where there is one to tell."""
    if over_lines(occurrences):
        return ["uri", "line", "char_start", "end_line", "char_end"]
    return ["uri", "line", "char_start", "char_end"] if end else ["uri", "line", "char_start"]


def at_position(occurrences: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, symbol_id) of the innermost occurrence that spans each request's position.

    Joined by file and line, so a position meets only its line's occurrences; the narrowest span wins, then the first. Occurrences
    with an end_line may span lines (spans.innermost).
    """
    if over_lines(occurrences):
        return spans.innermost(occurrences, requests)
    hit = requests.join(occurrences.select("uri", "line", "symbol_id", "char_start", "char_end"), ["uri", "line"]).where("char_start <= char and char < char_end")
    return hit.groupBy("request_id").agg(F.min_by("symbol_id", F.struct(F.col("char_end") - F.col("char_start"), "char_start", "symbol_id")).alias("symbol_id"))


def definitions(occurrences: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, uri, line, char_start) of the definitions of the symbol at each position; with spans over lines also their ends."""
    found = at_position(occurrences, requests).join(occurrences.where("role = 'definition'"), "symbol_id")
    return found.select("request_id", *_place(occurrences, False))


def type_definitions(occurrences: DataFrame, symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """As definitions, of the type of the symbol at each position."""
    types = at_position(occurrences, requests).join(symbols.where("type_id is not null").select("symbol_id", "type_id"), "symbol_id")
    found = types.select("request_id", F.col("type_id").alias("symbol_id")).join(occurrences.where("role = 'definition'"), "symbol_id")
    return found.select("request_id", *_place(occurrences, False))


def references(occurrences: DataFrame, requests: DataFrame, include_declaration: bool = True) -> DataFrame:
    """(request_id, uri, line, char_start, [end_line,] char_end) of all occurrences of the symbol at each position."""
    found = at_position(occurrences, requests).join(occurrences, "symbol_id")
    if not include_declaration:
        found = found.where("role <> 'definition'")
    return found.select("request_id", *_place(occurrences))


def hover(occurrences: DataFrame, symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, hover): signature and documentation of the symbol at each position."""
    return at_position(occurrences, requests).join(symbols, "symbol_id").select("request_id", F.concat_ws("\n", "signature", "doc").alias("hover"))


def incoming_calls(calls: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    """(symbol_id, caller_id, name) of the direct callers of the symbols ``of``."""
    return of.join(calls.select(F.col("callee_id").alias("symbol_id"), "caller_id").distinct(), "symbol_id").join(symbols.select(F.col("symbol_id").alias("caller_id"), "name"), "caller_id").select("symbol_id", "caller_id", "name")


def outgoing_calls(calls: DataFrame, symbols: DataFrame, of: DataFrame) -> DataFrame:
    """(symbol_id, callee_id, name) of what the symbols ``of`` call directly."""
    return of.join(calls.select(F.col("caller_id").alias("symbol_id"), "callee_id").distinct(), "symbol_id").join(symbols.select(F.col("symbol_id").alias("callee_id"), "name"), "callee_id").select("symbol_id", "callee_id", "name")


def reachable_calls(calls: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(symbol_id, callee_id, hops) within so many calls; call graphs have cycles, so the depth is bounded."""
    edge = calls.select("caller_id", "callee_id").distinct()
    now = start.join(edge.withColumnRenamed("caller_id", "symbol_id"), "symbol_id").select("symbol_id", "callee_id", F.lit(1).alias("hops"))
    out = now
    for k in range(2, depth + 1):
        nxt = edge.withColumnRenamed("callee_id", "to_")
        now = now.join(nxt, now["callee_id"] == nxt["caller_id"]).select("symbol_id", F.col("to_").alias("callee_id"), F.lit(k).alias("hops")).distinct()
        out = out.union(now)
    return out.groupBy("symbol_id", "callee_id").agg(F.min("hops").alias("hops"))


def rename_edits(occurrences: DataFrame, requests: DataFrame, new_name: str = "new_name") -> DataFrame:
    """(request_id, uri, line, char_start, char_end, new_text): one edit for each occurrence. requests also have the new name."""
    return references(occurrences, requests).join(requests.select("request_id", F.col(new_name).alias("new_text")), "request_id")


def _edit(edits: DataFrame) -> Column:
    return F.struct(*[c for c in ("line", "char_start", "end_line", "char_end", "new_text") if c in edits.columns])


def file_edits(edits: DataFrame) -> DataFrame:
    """(request_id, uri, edits): each file's edits in order; a row holds one file's edits of one request."""
    return edits.groupBy("request_id", "uri").agg(F.array_sort(F.collect_list(_edit(edits))).alias("edits"))


def edits_by_file(edits: DataFrame) -> DataFrame:
    """(request_id, changes): the map form of a workspace edit, uri to its edits in order. One row holds a whole edit; where that may
    be too much, file_edits has it in parts."""
    by = file_edits(edits)
    return by.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("uri", "edits")))).alias("changes"))


def document_changes(edits: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(request_id, document_changes): the other form of a workspace edit, an array of (uri, version, edits) in order of uri.
    versions: (uri, version) of files that are open; others have none."""
    by = file_edits(edits)
    by = by.withColumn("version", F.lit(None).cast("int")) if versions is None else by.join(versions.select("uri", F.col("version").cast("int")), "uri", "left")
    return by.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("uri", "version", "edits"))).alias("document_changes"))


def edits_of(results: DataFrame) -> DataFrame:
    """(request_id, uri, new_text) of workspace edits in either form: document_changes (uri, edits, where not edits is null),
    else the map changes."""
    modern = results.where("document_changes is not null").select("request_id", F.explode("document_changes").alias("d")).where("d.edits is not null").select("request_id", "d.uri", F.explode("d.edits").alias("new_text"))
    old = results.where("document_changes is null").select("request_id", F.explode("changes").alias("uri", "edits")).select("request_id", "uri", F.explode("edits").alias("new_text"))
    return modern.unionByName(old)


def latest_diagnostics(pushes: DataFrame) -> DataFrame:
    """Each file's latest push (uri, push_seq, ..): a later one replaces an earlier one, be it empty."""
    rest = [c for c in pushes.columns if c != "uri"]
    return pushes.groupBy("uri").agg(F.max_by(F.struct(*rest), "push_seq").alias("p")).select("uri", "p.*")


def get_diagnostics(pushes: DataFrame, files: DataFrame) -> DataFrame:
    """files (uri) with the diagnostics of their latest push; an empty array for files that none came for."""
    latest = latest_diagnostics(pushes).select("uri", "push_seq", "diagnostics")
    return files.join(latest, "uri", "left").withColumn("diagnostics", F.coalesce("diagnostics", F.array().cast(pushes.schema["diagnostics"].dataType)))


def errors(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where(F.col("severity") == SEVERITY_ERROR)


def row_of_latest(pushes: DataFrame) -> DataFrame:
    """latest_diagnostics by a window, for pushes whose rows should stay whole."""
    w = Window.partitionBy("uri").orderBy(F.desc("push_seq"))
    return pushes.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
