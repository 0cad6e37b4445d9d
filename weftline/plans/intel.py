"""Queries over symbols, occurrences, calls and diagnostics, and the checks that tests of such answers make."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.model import SYMBOL_KINDS, symbol_kinds
from weftline.operators import intel
from weftline.plans import views

T, S, P = views.TREE_SQL, views.FACTS_SQL, views.PUSH_SQL
KINDS_SQL = "kinds AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(SYMBOL_KINDS, 1)) + ") t(kind, kind_name))"
WALK_SQL = f"""WITH RECURSIVE {T}, walk AS (SELECT *, 0 AS level, name AS path FROM tree WHERE parent_id IS NULL
UNION ALL SELECT tree.*, level + 1, path || '/' || tree.name FROM walk JOIN tree ON tree.parent_id = walk.symbol_id)"""
#: Where each part is used: requests stand at the definitions of parts.
USES_SQL = """SELECT p_partkey AS request_id, 'file:///o' || l_orderkey AS uri, l_linenumber AS line, (l_suppkey % 20)::INT AS char_start,
  (l_suppkey % 20 + 5 + l_partkey % 5)::INT AS char_end FROM part JOIN lineitem ON l_partkey = p_partkey"""
QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


@query(f"WITH {T}, {KINDS_SQL}, k AS (SELECT symbol_id, CASE WHEN ord % 10 = 9 THEN 90 ELSE kind END AS kind FROM tree) SELECT symbol_id, kind, coalesce(kind_name, 'Kind(' || kind || ')') AS kind_name FROM k LEFT JOIN kinds USING (kind)")
def prj5_kind_name(spark, sf):
    odd = views.symbol_tree(spark, sf).select("symbol_id", F.when(F.col("ord") % 10 == 9, 90).otherwise(F.col("kind")).alias("kind"))
    return text.kind_name(odd, symbol_kinds(spark)).select("symbol_id", "kind", "kind_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'target' || l_partkey WHEN l_partkey % 3 = 1 THEN 'uri' || l_partkey ELSE 'text' END AS place FROM lineitem")
def prj13_location_uri(spark, sf):
    li = views.table(spark, sf, "lineitem")
    k = F.col("l_partkey") % 3
    return li.select("l_orderkey", "l_linenumber", "l_partkey", text.location_uri(F.when(k == 0, F.concat(F.lit("target"), "l_partkey")), F.when(k == 1, F.concat(F.lit("uri"), "l_partkey")), F.lit("text")).alias("place"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE '' END AS hover FROM part")
def prj14_hover_text(spark, sf):
    p = views.table(spark, sf, "part")
    j = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.struct(F.col("p_name").alias("value")).alias("contents")))).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.col("p_type").alias("contents")))).otherwise(F.lit(None))
    return p.select("p_partkey", text.hover_text(F.parse_json(j)).alias("hover"))


@query("SELECT p_partkey, 'm' || p_partkey AS name, 1 AS line, 4 AS char FROM part UNION ALL SELECT p_partkey, 'alone', 2, 2 FROM part")
def prj15_markers(spark, sf):
    """Positions of marker comments in a small source made for each part."""
    return text.markers(_lines(spark, sf), "## MARK:", ["p_partkey"])


def _lines(spark, sf):
    p = views.table(spark, sf, "part")
    source = F.concat(F.lit("import x\ndef f"), "p_partkey", F.lit("(a):  ## MARK:m"), "p_partkey", F.lit("\n  ## MARK:alone\nreturn f"), "p_partkey", F.lit("(1)\n"))
    return text.source_lines(p.select("p_partkey", source.alias("text")))


@query("SELECT p_partkey, 'alone' AS name, 3 AS line, 7 AS char FROM part")
def prj16_find_after(spark, sf):
    lines = _lines(spark, sf)
    return text.find_after(lines, text.markers(lines, "## MARK:", ["p_partkey"]), "f", ["p_partkey"]).where("name = 'alone'")


@query("""SELECT o_orderkey AS request_id, 'file:///o' || o_orderkey AS uri, o_orderstatus AS new_text FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT o_orderkey, 'file:///c' || o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0""")
def prj17_edits(spark, sf):
    o = views.table(spark, sf, "orders")
    one = F.struct(F.concat(F.lit("file:///o"), "o_orderkey").alias("uri"), F.array("o_orderstatus").alias("edits"))
    two = F.struct(F.concat(F.lit("file:///c"), "o_custkey").alias("uri"), F.array("o_orderpriority").alias("edits"))
    skip = F.struct(F.lit("file:///renamed").alias("uri"), F.lit(None).cast("array<string>").alias("edits"))
    k = F.col("o_orderkey") % 3
    # 0: the modern form, 1: modern without any text edit, 2: the map form
    modern = F.when(k == 0, F.array(one, skip, two)).when(k == 1, F.array(skip))
    old = F.when(k == 2, F.create_map(F.concat(F.lit("file:///o"), "o_orderkey"), F.array("o_orderstatus")))
    return intel.edits_of(o.select(F.col("o_orderkey").alias("request_id"), modern.alias("document_changes"), old.alias("changes")))


@query(f"WITH {P} SELECT uri, push_seq, message FROM push WHERE severity = 1")
def flt8_errors(spark, sf):
    return intel.errors(views.pushes(spark, sf)).select("uri", "push_seq", "message")


@query(f"WITH {P}, l AS (SELECT uri, max(push_seq) AS push_seq FROM push GROUP BY 1) SELECT 'file:///u' || user_id AS uri, max(push_seq) AS push_seq FROM events LEFT JOIN l ON uri = 'file:///u' || user_id GROUP BY ALL")
def jn7_diagnostics_by_uri(spark, sf):
    files = views.table(spark, sf, "events").select(F.concat(F.lit("file:///u"), "user_id").alias("uri")).distinct()
    return intel.get_diagnostics(views.pushes(spark, sf), files).select("uri", "push_seq")


@query("SELECT n_name AS name, 'n' || n_nationkey AS symbol_id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 30 = 0)")
def jn8_missing_children(spark, sf):
    """Classes without any child of those expected: an anti join."""
    tree = views.symbol_tree(spark, sf)
    return intel.without_child(tree.where("kind = 5"), tree.where("kind = 6 and ord % 30 = 0")).select("name", "symbol_id")


def _refs(spark, sf, declared=True):
    return intel.references(views.occurrences(spark, sf), views.part_requests(spark, sf), declared)


@query(f"WITH {S} SELECT request_id, count(*) AS edits, count(DISTINCT o.uri) AS files FROM spot JOIN occ o USING (symbol_id) GROUP BY 1")
def agg7_edit_counts(spark, sf):
    edits = intel.rename_edits(views.occurrences(spark, sf), views.part_requests(spark, sf))
    return edits.groupBy("request_id").agg(F.count("*").alias("edits"), F.count_distinct("uri").alias("files"))


@query(f"WITH {S} SELECT request_id, count(*) AS n FROM spot JOIN occ USING (symbol_id) GROUP BY 1 HAVING count(*) >= 20")
def agg8_least_counts(spark, sf):
    return _refs(spark, sf).groupBy("request_id").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"WITH {T} SELECT DISTINCT name FROM tree")
def agg9_distinct_names(spark, sf):
    return intel.distinct_names(views.symbol_tree(spark, sf))


@query(f"WITH {P} SELECT uri, max(push_seq) AS push_seq, arg_max(message, push_seq) AS message FROM push GROUP BY 1")
def win4_latest_push(spark, sf):
    return intel.row_of_latest(views.pushes(spark, sf)).select("uri", "push_seq", "message")


@query(f"{WALK_SQL} SELECT uri, symbol_id, level, path FROM walk")
def lq1_document_symbols(spark, sf):
    """The outline of every file; one file's is a filter on uri."""
    return intel.walk(views.symbol_tree(spark, sf), 3).select("uri", "symbol_id", "level", "path")


@query(f"WITH {T} SELECT symbol_id, name, kind, uri FROM tree WHERE contains(lower(name), 'on_1') OR contains(lower(name), 'er#0000001')")
def lq2_workspace_symbols(spark, sf):
    """Two searches, in any case and with the parentheses of a call."""
    tree = views.symbol_tree(spark, sf)
    found = intel.workspace_symbols(tree, "oN_1").union(intel.workspace_symbols(tree, "ER#0000001()"))
    return found.select("symbol_id", "name", "kind", "uri")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, min(l_suppkey % 20) + 1 AS c FROM lineitem GROUP BY ALL),
hit AS (SELECT l_orderkey, l_linenumber, arg_min(l_partkey, {'w': l_partkey % 5, 's': l_suppkey % 20, 'n': 'p' || l_partkey}) AS partkey
  FROM lineitem JOIN r USING (l_orderkey, l_linenumber) WHERE l_suppkey % 20 <= c AND c < l_suppkey % 20 + 5 + l_partkey % 5 GROUP BY ALL)
SELECT l_orderkey * 100 + l_linenumber AS request_id, 'file:///part/' || p_brand AS uri, p_partkey::INT AS line, 0 AS char_start FROM hit JOIN part ON p_partkey = partkey""")
def lq3_definitions(spark, sf):
    """The definition of what stands in each line of each order."""
    return intel.definitions(views.occurrences(spark, sf), views.line_requests(spark, sf))


@query("SELECT p_partkey AS request_id, 'file:///type/' || p_type AS uri, 0 AS line, 0 AS char_start FROM part")
def lq4_type_definitions(spark, sf):
    return intel.type_definitions(views.occurrences(spark, sf), views.part_symbols(spark, sf), views.part_requests(spark, sf))


@query(f"{USES_SQL} UNION ALL SELECT p_partkey, 'file:///part/' || p_brand, p_partkey::INT, 0, length(p_name)::INT FROM part")
def lq5_references(spark, sf):
    return _refs(spark, sf)


@query(USES_SQL)
def lq5_references_without_declaration(spark, sf):
    return _refs(spark, sf, False)


@query(f"WITH {S} SELECT request_id, concat_ws(chr(10), signature, doc) AS hover FROM spot JOIN sym USING (symbol_id)")
def lq6_hover(spark, sf):
    return intel.hover(views.occurrences(spark, sf), views.part_symbols(spark, sf), views.part_requests(spark, sf))


@query(f"WITH {S} SELECT callee_id AS symbol_id, caller_id, s.name FROM call JOIN sym s ON s.symbol_id = caller_id")
def lq7_incoming_calls(spark, sf):
    of = views.part_symbols(spark, sf).where("symbol_id like 'p%'").select("symbol_id")
    return intel.incoming_calls(views.calls(spark, sf), views.part_symbols(spark, sf), of)


@query(f"WITH {S} SELECT caller_id AS symbol_id, callee_id, s.name FROM call JOIN sym s ON s.symbol_id = callee_id")
def lq8_outgoing_calls(spark, sf):
    of = views.part_symbols(spark, sf).where("symbol_id like 's%'").select("symbol_id")
    return intel.outgoing_calls(views.calls(spark, sf), views.part_symbols(spark, sf), of)


@query(f"SELECT *, 'renamed_' || request_id AS new_text FROM ({USES_SQL} UNION ALL SELECT p_partkey, 'file:///part/' || p_brand, p_partkey::INT, 0, length(p_name)::INT FROM part)")
def lq9_rename(spark, sf):
    return intel.rename_edits(views.occurrences(spark, sf), views.part_requests(spark, sf))


@query(f"WITH {S}, e AS (SELECT request_id, occ.uri, count(*) AS n FROM spot JOIN occ USING (symbol_id) GROUP BY ALL) SELECT request_id, count(*) AS files, sum(n)::BIGINT AS edits FROM e GROUP BY 1")
def lq9_rename_by_file(spark, sf):
    edits = intel.edits_by_file(intel.rename_edits(views.occurrences(spark, sf), views.part_requests(spark, sf)))
    total = F.aggregate(F.map_values("changes"), F.lit(0).cast("long"), lambda acc, x: acc + F.size(x))
    return edits.select("request_id", F.size("changes").cast("long").alias("files"), total.alias("edits"))


@query(f"WITH {P}, l AS (SELECT uri, max(push_seq) AS push_seq, arg_max(diagnostics, push_seq) AS diagnostics FROM push GROUP BY 1), f AS (SELECT DISTINCT 'file:///u' || user_id AS uri FROM events) SELECT uri, push_seq, coalesce(diagnostics, []) AS diagnostics FROM f LEFT JOIN l USING (uri)")
def lq10_get_diagnostics(spark, sf):
    files = views.table(spark, sf, "events").select(F.concat(F.lit("file:///u"), "user_id").alias("uri")).distinct()
    return intel.get_diagnostics(views.pushes(spark, sf), files).select("uri", "push_seq", "diagnostics")


@query(f"WITH {views.EVENTS_SQL} SELECT seq, 'file://' || abs_path AS uri, CASE change WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END AS type FROM ev WHERE suffix(abs_path, '.py')")
def lq12_notifications(spark, sf):
    from weftline.operators import changes

    sent = changes.translate(views.events(spark, sf, False), [".py"])
    return sent.select("seq", "uri", F.when(F.col("type") == "Created", 1).when(F.col("type") == "Changed", 2).otherwise(3).alias("type"))


@query(f"WITH {views.EVENTS_SQL} SELECT seq, CASE change WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END AS type FROM ev")
def lq13_raw_notifications(spark, sf):
    return views.events(spark, sf, False).select("seq", text.change_number(F.col("change")).alias("type"))


@query(f"{WALK_SQL} SELECT symbol_id, path, repeat('  ', level) || name AS line FROM walk")
def rec1_outline(spark, sf):
    return intel.outline(intel.walk(views.symbol_tree(spark, sf), 3))


@query(f"{WALK_SQL} SELECT DISTINCT name FROM walk")
def rec2_all_names(spark, sf):
    return intel.walk(views.symbol_tree(spark, sf), 3).select("name").distinct()


@query(f"{WALK_SQL}, {KINDS_SQL} SELECT path, kind_name FROM walk JOIN kinds USING (kind)")
def rec3_kinds_with_path(spark, sf):
    return text.kind_name(intel.walk(views.symbol_tree(spark, sf), 3), symbol_kinds(spark)).select("path", "kind_name")


@query(f"{WALK_SQL} SELECT path, 'Odd' AS kind_name FROM walk WHERE ord % 50 = 0")
def rec4_unknown_kinds(spark, sf):
    odd = text.kind_name(intel.walk(views.symbol_tree(spark, sf), 3), symbol_kinds(spark)).withColumn("kind_name", F.when(F.col("ord") % 50 == 0, "Odd").otherwise(F.col("kind_name")))
    return intel.unknown_kinds(odd, symbol_kinds(spark)).select("path", "kind_name")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT 'n' || c_nationkey AS caller_id, 'n' || ((c_nationkey * 7 + c_custkey % 3) % 25) AS callee_id FROM customer),
w AS (SELECT caller_id AS symbol_id, callee_id, 1 AS hops FROM c UNION SELECT symbol_id, c.callee_id, hops + 1 FROM w JOIN c ON c.caller_id = w.callee_id WHERE hops < 3)
SELECT symbol_id, callee_id, min(hops) AS hops FROM w GROUP BY ALL""")
def rec5_reachable_calls(spark, sf):
    """Calls within three hops in a graph with cycles."""
    c = views.table(spark, sf, "customer")
    calls = c.select(F.concat(F.lit("n"), "c_nationkey").alias("caller_id"), F.concat(F.lit("n"), ((F.col("c_nationkey") * 7 + F.col("c_custkey") % 3) % 25).cast("string")).alias("callee_id"))
    return intel.reachable_calls(calls, calls.select(F.col("caller_id").alias("symbol_id")).distinct(), 3)


@query(f"WITH {P} SELECT uri, max(push_seq) AS push_seq FROM push GROUP BY 1")
def st2_latest_state(spark, sf):
    """Latest diagnostics by state over a stream of pushes; the state's updates are written and the last of each file read."""
    from weftline.plans.watching import _folder, _stream_path
    from weftline.streaming.diagnostics import latest_stream

    folder = _folder(spark)
    stream = spark.readStream.schema(views.table(spark, sf, "events").schema).parquet(*_stream_path(sf)).where("event_type = 'error'")
    pushed = stream.select(F.concat(F.lit("file:///u"), "user_id").alias("uri"), F.col("event_id").alias("push_seq"), F.col("props").alias("diagnostics"))

    def write(frame, number):
        frame.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    latest_stream(pushed).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("uri string, push_seq long, diagnostics string").parquet(f"{folder}/out").groupBy("uri").agg(F.max("push_seq").alias("push_seq"))


@query("""SELECT 0 AS level, r_name AS path, r_name AS name, 'Namespace' AS kind_category FROM region
UNION ALL SELECT 1, r_name || '/' || n_name, n_name, 'Class' FROM region JOIN nation ON n_regionkey = r_regionkey""")
def src6_ground_truth(spark, sf):
    """Symbols of ground-truth files written from the symbol tree and read back as VARIANT."""
    from weftline.plans.watching import _folder
    from weftline.sources import truth

    tree = views.symbol_tree(spark, sf)
    nations = tree.where("kind = 5").select("parent_id", F.struct("name", F.lit("Class").alias("kind_category"), F.array().cast("array<string>").alias("children")).alias("c"))
    docs = tree.where("kind = 3").join(nations.groupBy(F.col("parent_id").alias("symbol_id")).agg(F.collect_list("c").alias("children")), "symbol_id")
    folder = f"{_folder(spark)}/truth-{uuid.uuid4().hex}"
    symbols = F.to_json(F.struct(F.lit(3).alias("schema_version"), F.array(F.struct("name", F.lit("Namespace").alias("kind_category"), "children")).alias("symbols")))
    docs.select(symbols.alias("value"), "name").repartition("name").write.partitionBy("name").text(folder)
    read = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_name").alias("file"), F.parse_json("value").alias("doc"))
    return truth.symbol_tree(read, 3).select("level", "path", "name", "kind_category")


#: A tree of each 400 events, as deep: every seventh begins at a parent that is missing, every eleventh is closed to a cycle.
DEEP_SQL = """t AS (SELECT event_id AS id, event_id // 400 AS k, event_id % 400 AS j, 'e' || event_id % 17 AS name FROM events),
deep AS (SELECT id, name, CASE WHEN j > 0 THEN id - 1 WHEN k % 7 = 3 THEN -id - 1 WHEN k % 11 = 5 THEN least(id + 399, (SELECT max(id) FROM t)) END AS parent FROM t)"""


def deep_tree(spark, sf):
    """(symbol_id, parent_id, name): long chains, some without a root."""
    e = views.table(spark, sf, "events").select(F.col("event_id").alias("symbol_id"), F.floor(F.col("event_id") / 400).alias("k"), (F.col("event_id") % 400).alias("j"))
    last = e.agg(F.max("symbol_id").alias("last"))
    e = e.crossJoin(F.broadcast(last))  # one row
    closed = F.when(F.col("k") % 7 == 3, -F.col("symbol_id") - 1).when(F.col("k") % 11 == 5, F.least(F.col("symbol_id") + 399, "last"))
    return e.select("symbol_id", F.when(F.col("j") > 0, F.col("symbol_id") - 1).otherwise(closed).alias("parent_id"), F.concat(F.lit("e"), F.col("symbol_id") % 17).alias("name"))


@query(f"""WITH RECURSIVE {DEEP_SQL}, top AS (SELECT id, parent FROM deep WHERE parent IS NULL OR parent NOT IN (SELECT id FROM deep)),
down AS (SELECT d.id, d.name AS path, 0 AS level, d.id AS top, CASE WHEN d.parent IS NULL THEN 'root' ELSE 'orphan' END AS reached FROM deep d JOIN top USING (id)
  UNION ALL SELECT d.id, path || '/' || d.name, level + 1, top, reached FROM down JOIN deep d ON d.parent = down.id)
SELECT deep.id AS symbol_id, level, top, sha256(path) AS path_sha256, coalesce(reached, 'cycle') AS reached FROM deep LEFT JOIN down USING (id)""")
def rec1_deep_paths(spark, sf):
    """Paths in deep trees by pointer doubling, orphans and cycles told apart."""
    found = intel.walk(deep_tree(spark, sf))
    return found.select("symbol_id", "level", "top", F.sha2(F.col("path").cast("binary"), 256).alias("path_sha256"), "reached")


@query(f"""WITH {DEEP_SQL} SELECT id AS symbol_id, parent AS parent_id, CASE WHEN parent IN (SELECT id FROM deep) THEN 'on a cycle or below one' ELSE 'parent is missing' END AS problem
FROM deep d WHERE parent IS NOT NULL AND (parent NOT IN (SELECT id FROM deep) OR id // 400 IN (SELECT id // 400 FROM deep WHERE parent >= id))""")
def lq1_symbols_without_a_root(spark, sf):
    """What an outline cannot place: symbols whose parent is missing, and those that never come to a root."""
    tree = deep_tree(spark, sf)
    found = intel.walk(tree).where((F.col("reached") == "cycle") | ((F.col("reached") == "orphan") & (F.col("level") == 0)))
    return found.select("symbol_id", "parent_id", F.when(F.col("reached") == "cycle", "on a cycle or below one").otherwise("parent is missing").alias("problem"))


#: Each change of a file gives it a new text: a class with one method, which makes one call, and a function.
SOURCE_SQL = f"""WITH {views.LOG_SQL}, last AS (SELECT 'file://' || abs_path AS uri, arg_max(change, event_id) AS change, max(event_id) AS seq FROM log GROUP BY abs_path),
src AS (SELECT uri, 'F' || seq % 11 AS cls, 'm' || seq % 5 AS meth, 'g' || seq % 3 AS callee, 'top' || seq % 4 AS fn FROM last WHERE change <> 'deleted')"""


def source_changes(spark, sf):
    """(uri, seq, deleted, text) of the change log."""
    log = views.change_log(spark, sf, False)
    k = F.col("event_id")
    part = lambda name, n: F.concat(F.lit(name), (k % n).cast("string"))
    source = F.concat(F.lit("class "), part("F", 11), F.lit(":\n    def "), part("m", 5), F.lit("(self):\n        return "), part("g", 3), F.lit("()\n\ndef "), part("top", 4), F.lit("():\n    pass\n"))
    return log.select(F.concat(F.lit("file://"), "abs_path").alias("uri"), k.alias("seq"), (F.col("change") == "deleted").alias("deleted"), F.when(F.col("change") != "deleted", source).alias("text"))


def followed(spark, sf):
    """A store that has followed the change log in four batches of a stream, and then got the third one once more."""
    from weftline.session import shared_folder
    from weftline.sources import pysymbols
    from weftline.streaming import facts

    folder = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    log = source_changes(spark, sf)
    log.repartitionByRange(4, "seq").write.parquet(f"{folder}/log")
    tables = {"symbols": (pysymbols.SYMBOL, pysymbols.python_symbols), "calls": (pysymbols.CALL, pysymbols.python_calls)}
    store = facts.FactStore(spark, f"{folder}/store", tables, 16)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    facts.follow(stream, store, f"{folder}/state", "log").awaitTermination()
    if store.apply(log, 2, "log"):
        raise AssertionError("a batch was applied twice")
    return store


@query(f"""{SOURCE_SQL} SELECT uri, uri || '::' || cls AS symbol_id, NULL AS parent_id, cls AS name, 5 AS kind, 0 AS line FROM src
UNION ALL SELECT uri, uri || '::' || cls || '::' || meth, uri || '::' || cls, meth, 6, 1 FROM src UNION ALL SELECT uri, uri || '::' || fn, NULL, fn, 12, 4 FROM src""")
def lq12_reindexed_symbols(spark, sf):
    """Symbols after the change log has been followed batch by batch: those of each file's last text."""
    return followed(spark, sf).facts("symbols").select("uri", "symbol_id", "parent_id", "name", "kind", "line")


@query(f"{SOURCE_SQL} SELECT uri, uri || '::' || cls || '::' || meth AS caller_id, callee, 2 AS line FROM src")
def lq12_reindexed_calls(spark, sf):
    return followed(spark, sf).facts("calls")


@query(f"{SOURCE_SQL} SELECT uri, seq, change = 'deleted' AS deleted FROM last")
def lq12_followed_files(spark, sf):
    """What the store knows of each file: its last change, and whether that deleted it."""
    return followed(spark, sf).facts("files")


#: Files of orders: a function over all lines, a block for each line item, which may reach into the next ones, and a name in it.
SPANS_SQL = """sp AS (
  SELECT 'o' || o_orderkey AS symbol_id, 'file:///o' || o_orderkey AS uri, 0 AS line, 0 AS char_start, 60 AS end_line, 1 AS char_end, 'reference' AS role FROM orders
  UNION ALL SELECT 's' || l_suppkey, 'file:///o' || l_orderkey, l_linenumber * 6, (l_suppkey % 20)::INT, l_linenumber * 6 + (l_quantity::INT % 9), (l_partkey % 30 + 21)::INT, 'reference' FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 'file:///o' || l_orderkey, l_linenumber * 6 + 1, 4, l_linenumber * 6 + 1, (5 + l_partkey % 9)::INT, 'reference' FROM lineitem
  UNION ALL SELECT 'p' || p_partkey, 'file:///part/' || p_brand, p_partkey::INT * 3, 0, p_partkey::INT * 3 + 2, 7, 'definition' FROM part
  UNION ALL SELECT 's' || s_suppkey, 'file:///supplier', s_suppkey::INT * 40, 2, s_suppkey::INT * 40 + 30, 9, 'definition' FROM supplier),
rq AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, 'file:///o' || l_orderkey AS uri, l_linenumber * 6 + (l_suppkey % 4)::INT AS line, (l_orderkey % 25)::INT AS char FROM lineitem),
hit AS (SELECT request_id, arg_min(symbol_id, {'a': end_line - sp.line, 'b': char_end - char_start, 'c': sp.line, 'd': char_start, 'e': symbol_id}) AS symbol_id FROM rq JOIN sp USING (uri)
  WHERE (sp.line, char_start) <= (rq.line, char) AND (rq.line, char) < (end_line, char_end) GROUP BY request_id)"""


def spans_over_lines(spark, sf):
    """(occurrences, requests) of SPANS_SQL."""
    o, li, p, s = (views.table(spark, sf, t) for t in ("orders", "lineitem", "part", "supplier"))
    text = lambda prefix, c: F.concat(F.lit(prefix), c)

    def rows(df, symbol, uri, line, start, end_line, end, role):
        places = (line, start, end_line, end)
        return df.select(symbol.alias("symbol_id"), uri.alias("uri"), *[F.lit(v).cast("int").alias(n) for v, n in zip(places, ("line", "char_start", "end_line", "char_end"), strict=True)], F.lit(role).alias("role"))

    order, six = text("file:///o", "l_orderkey"), F.col("l_linenumber") * 6
    key, supplier = F.col("p_partkey"), F.col("s_suppkey")
    occurrences = (
        rows(o, text("o", "o_orderkey"), text("file:///o", "o_orderkey"), 0, 0, 60, 1, "reference")
        .union(rows(li, text("s", "l_suppkey"), order, six, F.col("l_suppkey") % 20, six + F.col("l_quantity").cast("int") % 9, F.col("l_partkey") % 30 + 21, "reference"))
        .union(rows(li, text("p", "l_partkey"), order, six + 1, 4, six + 1, F.col("l_partkey") % 9 + 5, "reference"))
        .union(rows(p, text("p", "p_partkey"), text("file:///part/", "p_brand"), key * 3, 0, key * 3 + 2, 7, "definition"))
        .union(rows(s, text("s", "s_suppkey"), F.lit("file:///supplier"), supplier * 40, 2, supplier * 40 + 30, 9, "definition"))
    )
    requests = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), order.alias("uri"), (six + F.col("l_suppkey") % 4).cast("int").alias("line"), (F.col("l_orderkey") % 25).cast("int").alias("char"))
    return occurrences, requests


@query(f"WITH {SPANS_SQL} SELECT request_id, symbol_id FROM hit")
def lq6_innermost_spans(spark, sf):
    """The innermost of nested and overlapping spans over lines at each position."""
    return intel.at_position(*spans_over_lines(spark, sf))


@query(f"WITH {SPANS_SQL} SELECT request_id, uri, line, char_start, end_line, char_end FROM hit JOIN sp USING (symbol_id) WHERE role = 'definition'")
def lq3_definitions_over_lines(spark, sf):
    return intel.definitions(*spans_over_lines(spark, sf))


@query(f"WITH {SPANS_SQL} SELECT symbol_id, count(*) AS requests, sum(n) AS found, sum(lines) AS lines FROM hit JOIN (SELECT symbol_id, count(*) AS n, sum(end_line - line + 1) AS lines FROM sp WHERE role <> 'definition' GROUP BY 1) USING (symbol_id) GROUP BY 1")
def lq5_references_over_lines(spark, sf):
    """How many requests each symbol gets, and the references found for them."""
    occurrences, requests = spans_over_lines(spark, sf)
    found = intel.at_position(occurrences, requests)
    uses = occurrences.where("role <> 'definition'").groupBy("symbol_id").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("line") + 1).alias("lines"))
    asked = found.groupBy("symbol_id").agg(F.count("*").alias("requests"))
    return asked.join(uses, "symbol_id").select("symbol_id", "requests", (F.col("n") * F.col("requests")).alias("found"), (F.col("lines") * F.col("requests")).alias("lines"))


#: Queries of one character and more, some of which find nothing.
SEARCH_SQL = """q AS (SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN upper(substr(p_name, 3, 6)) WHEN 1 THEN substr(p_name, 1, 1 + (c_custkey % 3)::INT) WHEN 2 THEN c_custkey || '9()' WHEN 3 THEN '' ELSE substr(p_name, 2, 12) || '()' END AS query
  FROM customer JOIN part ON p_partkey = c_custkey)"""


@query(f"WITH {SEARCH_SQL}, n AS (SELECT s_suppkey AS id, 's' || s_suppkey AS symbol_id, s_name AS name FROM supplier UNION ALL SELECT p_partkey, 'p' || p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN '()' ELSE '' END FROM part),\n"
       r"k AS (SELECT query_id, regexp_replace(lower(query), '\(\)$', '') AS asked FROM q) SELECT query_id, symbol_id, name FROM k JOIN n ON asked <> '' AND contains(regexp_replace(lower(name), '\(\)$', ''), asked)")
def lq2_gram_index(spark, sf):
    """Many symbol searches at once by the stored index of grams."""
    from weftline.operators.symbolindex import SymbolIndex
    from weftline.session import shared_folder

    p, s, c = (views.table(spark, sf, t) for t in ("part", "supplier", "customer"))
    parts = p.select(F.concat(F.lit("p"), "p_partkey").alias("symbol_id"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "()").otherwise("")).alias("name"))
    index = SymbolIndex(spark, f"{shared_folder(spark)}/names-{uuid.uuid4().hex}").build(parts.union(s.select(F.concat(F.lit("s"), "s_suppkey").alias("symbol_id"), "s_name")), 16)
    k, name = F.col("c_custkey"), F.col("p_name")
    text = F.when(k % 5 == 0, F.upper(F.substring(name, 3, 6))).when(k % 5 == 1, F.substr(name, F.lit(1), (k % 3 + 1).cast("int"))).when(k % 5 == 2, F.concat(k, F.lit("9()"))).when(k % 5 == 3, "").otherwise(F.concat(F.substring(name, 2, 12), F.lit("()")))
    return index.search_all(c.join(p, k == p["p_partkey"]).select(k.alias("query_id"), text.alias("query")))


@query(f"WITH {S}, e AS (SELECT request_id, o.uri, o.line, o.char_start, o.char_end, new_name AS new_text FROM preq JOIN spot USING (request_id) JOIN occ o USING (symbol_id)), "
       "f AS (SELECT request_id, uri, count(*) AS n, min(new_text) AS new_text FROM e GROUP BY ALL) SELECT request_id, len(list(uri)) AS files, sum(n)::BIGINT AS edits, list(uri ORDER BY uri) AS uris FROM f GROUP BY request_id")
def lq9_document_changes(spark, sf):
    """A rename in the form of changed documents."""
    edits = intel.rename_edits(views.occurrences(spark, sf), views.part_requests(spark, sf))
    d = intel.document_changes(edits)
    return d.select("request_id", F.size("document_changes").cast("long").alias("files"), F.aggregate("document_changes", F.lit(0).cast("long"), lambda s, x: s + F.size(x["edits"])).alias("edits"), F.transform("document_changes", lambda x: x["uri"]).alias("uris"))
