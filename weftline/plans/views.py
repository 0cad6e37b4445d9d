"""Adapter views: change logs, roots, symbols, occurrences and calls read from the tables, in Spark and as SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import attribution, changes

#: Roots with a nested, a repeated and an equally named one; /ws/appx only looks like one.
ROOTS = ((1, "/ws/app"), (2, "/ws/app/lib"), (3, "/srv/app"), (4, "/data/ml"), (5, "/ws/app"))
BASES = ("/ws/app", "/ws/app/lib", "/srv/app", "/data/ml", "/ws/appx")
SUFFIXES = (".py", ".ts", ".md")
LANGUAGES = (("python", [".py", ".pyi"]), ("typescript", [".ts", ".tsx"]), ("any", []))
CUSTOM_IGNORES = {"/ws/app": ("d1/*.py", "d2", "d?/f1*"), "/srv/app": ("/srv/app/d3", "d4/", "d[5]/x"), "/data/ml": ("d6/*7.md",)}
#: What a version-control ignore file of each root would hold.
IGNORE_FILES = {"/ws/app": "# made\nf*0.py\n!/d3/f*0.py\nd5/\n!d5/f*7.ts\n", "/srv/app": "/d2/*.md\n**/f*2.md\n", "/data/ml": "*.ts\n"}
FAILED_ROOT = "/data/ml"
GAP, CAP = 7200 * 10**6, 14400 * 10**6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def each_row(df: DataFrame, schema: str, give) -> DataFrame:
    """The rows (tuples) that give(*row) has for each row, made in the tasks."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([out for row in frame.itertuples(index=False, name=None) for out in give(*row)], columns=names)

    return df.mapInPandas(run, schema)


def pick(index: Column, values: tuple) -> Column:
    """values[index]; the last for any other index."""
    out = F.lit(values[-1])
    for k in range(len(values) - 1):
        out = F.when(index == k, values[k]).otherwise(out)
    return out


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROOTS), "ord int, root string")


def host_roots(spark: SparkSession, sf: str) -> DataFrame:
    """(ord, root): a root for each page, by its host and the first part of its path; many are repeated, nested or of one name."""
    host, head = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.regexp_extract("url", "://[^/?#]*/([^/?#]*)", 1)
    pages = table(spark, sf, "pages").select("page_id", host.alias("host"), F.when(head == "", "top").otherwise(head).alias("head")).where("host <> ''")
    k = F.col("page_id") % 3
    root = F.when(k == 0, F.concat(F.lit("/"), "host")).when(k == 1, F.concat(F.lit("/"), "host", F.lit("/"), "head")).otherwise(F.concat(F.lit("/srv/"), "host"))
    return pages.select(F.col("page_id").alias("ord"), root.alias("root"))


def change_log(spark: SparkSession, sf: str, exists: bool = True) -> DataFrame:
    """(event_id, seq, us, day, user_id, change, abs_path, is_dir, exists_now): file changes read from events.

    A path exists now if its latest event is not a deletion.
    """
    e = table(spark, sf, "events")
    user = F.col("user_id")
    path = F.concat(pick(user % 5, BASES), F.lit("/d"), user % 7, F.lit("/f"), user, pick(user % 3, SUFFIXES))
    log = e.select("event_id", F.col("event_id").alias("seq"), changes.micros(F.col("ts")).alias("us"), F.to_date("ts").alias("day"), "user_id", F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("change"), path.alias("abs_path"), F.lit(False).alias("is_dir"))
    if not exists:
        return log
    last = log.groupBy("abs_path").agg((F.max_by("change", F.struct("us", "event_id")) != "deleted").alias("exists_now"))
    return log.join(last, "abs_path")


def events(spark: SparkSession, sf: str, exists: bool = True) -> DataFrame:
    """change_log with its roots' attribution; the roots are few, so it is a projection."""
    known = attribution.labels_of([root for _, root in ROOTS])
    return attribution.attribute_few(change_log(spark, sf, exists), known)


def url_paths(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, path): the URL's host and path as an absolute path."""
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", r"://([^?#]*)", 1)).alias("path"))


def symbol_tree(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol_id, parent_id, uri, name, kind, ord): regions, their nations and their customers as namespaces, classes, methods."""
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k))
    uri = lambda k: F.concat(F.lit("file:///r"), F.col(k))
    top = r.select(key("r", "r_regionkey").alias("symbol_id"), F.lit(None).cast("string").alias("parent_id"), uri("r_regionkey").alias("uri"), F.col("r_name").alias("name"), F.lit(3).alias("kind"), F.col("r_regionkey").cast("long").alias("ord"))
    mid = n.select(key("n", "n_nationkey").alias("symbol_id"), key("r", "n_regionkey").alias("parent_id"), uri("n_regionkey").alias("uri"), F.col("n_name").alias("name"), F.lit(5).alias("kind"), F.col("n_nationkey").cast("long").alias("ord"))
    low = c.join(F.broadcast(n.select("n_nationkey", "n_regionkey")), c["c_nationkey"] == F.col("n_nationkey")).select(key("c", "c_custkey").alias("symbol_id"), key("n", "c_nationkey").alias("parent_id"), uri("n_regionkey").alias("uri"), F.col("c_name").alias("name"), F.lit(6).alias("kind"), F.col("c_custkey").alias("ord"))
    return top.union(mid).union(low)


def part_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, part types and suppliers as symbols with signatures, documentation and types."""
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    parts = p.select(F.concat(F.lit("p"), "p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat(F.lit("t"), "p_type").alias("type_id"), F.concat_ws(" ", "p_brand", "p_name").alias("signature"), F.col("p_type").alias("doc"))
    types = p.select(F.concat(F.lit("t"), "p_type").alias("symbol_id"), F.col("p_type").alias("name")).distinct().select("symbol_id", "name", none.alias("type_id"), F.col("name").alias("signature"), none.alias("doc"))
    callers = s.select(F.concat(F.lit("s"), "s_suppkey").alias("symbol_id"), F.col("s_name").alias("name"), none.alias("type_id"), F.col("s_name").alias("signature"), none.alias("doc"))
    return parts.union(types).union(callers)


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as references of their part in their order's file; parts and types as definitions."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    start = (F.col("l_suppkey") % 20).cast("int")
    refs = li.select(F.concat(F.lit("p"), "l_partkey").alias("symbol_id"), F.concat(F.lit("file:///o"), "l_orderkey").alias("uri"), F.col("l_linenumber").alias("line"), start.alias("char_start"), (start + 5 + (F.col("l_partkey") % 5).cast("int")).alias("char_end"), F.lit("reference").alias("role"))
    defs = p.select(F.concat(F.lit("p"), "p_partkey").alias("symbol_id"), F.concat(F.lit("file:///part/"), "p_brand").alias("uri"), F.col("p_partkey").cast("int").alias("line"), F.lit(0).alias("char_start"), F.length("p_name").alias("char_end"), F.lit("definition").alias("role"))
    types = p.select("p_type").distinct().select(F.concat(F.lit("t"), "p_type").alias("symbol_id"), F.concat(F.lit("file:///type/"), "p_type").alias("uri"), F.lit(0).alias("line"), F.lit(0).alias("char_start"), F.length("p_type").alias("char_end"), F.lit("definition").alias("role"))
    return refs.union(defs).union(types)


def part_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request at the definition of each part."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("file:///part/"), "p_brand").alias("uri"), F.col("p_partkey").cast("int").alias("line"), F.lit(0).alias("char"), F.concat(F.lit("renamed_"), "p_partkey").alias("new_name"))


def line_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request within each line of each order."""
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("request_id"), F.concat(F.lit("file:///o"), "l_orderkey").alias("uri"), F.col("l_linenumber").alias("line"), ((F.col("l_suppkey") % 20).cast("int") + 1).alias("char")).groupBy("request_id", "uri", "line").agg(F.min("char").alias("char"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("caller_id"), F.concat(F.lit("p"), "l_partkey").alias("callee_id")).distinct()


def pushes(spark: SparkSession, sf: str) -> DataFrame:
    """(uri, push_seq, severity, message, diagnostics): error events as diagnostics pushed for a user's file."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select(F.concat(F.lit("file:///u"), "user_id").alias("uri"), F.col("event_id").alias("push_seq"), (F.col("event_id") % 4 + 1).cast("int").alias("severity"), F.col("props").alias("message"), F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("props")).alias("diagnostics"))


def _case(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


ROOTS_SQL = f"""
r0 AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{r}')" for k, r in ROOTS)}) t(ord, root)),
r1 AS (SELECT min(ord) AS ord, root FROM r0 GROUP BY root),
r2 AS (SELECT ord, root, list_last(string_split(root, '/')) AS base_name FROM r1),
roots AS (SELECT ord, root, base_name, CASE WHEN count(*) OVER (PARTITION BY base_name) = 1 THEN base_name
  ELSE base_name || '#' || row_number() OVER (PARTITION BY base_name ORDER BY ord) END AS label FROM r2)"""

HOST_ROOTS_SQL = """
h0 AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1), ''), 'top') AS head FROM pages),
r0 AS (SELECT page_id AS ord, CASE page_id % 3 WHEN 0 THEN '/' || host WHEN 1 THEN '/' || host || '/' || head ELSE '/srv/' || host END AS root FROM h0 WHERE host <> ''),
r1 AS (SELECT min(ord) AS ord, root FROM r0 GROUP BY root),
r2 AS (SELECT ord, root, list_last(string_split(root, '/')) AS base_name FROM r1),
roots AS (SELECT ord, root, base_name, CASE WHEN count(*) OVER (PARTITION BY base_name) = 1 THEN base_name
  ELSE base_name || '#' || row_number() OVER (PARTITION BY base_name ORDER BY ord) END AS label FROM r2)"""

LOG_SQL = f"""
log0 AS (SELECT event_id, event_id AS seq, epoch_us(ts) AS us, ts::DATE AS day, user_id,
  CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change,
  {_case('user_id % 5', BASES)} || '/d' || (user_id % 7) || '/f' || user_id || {_case('user_id % 3', SUFFIXES)} AS abs_path FROM events),
log AS (SELECT *, last_value(change) OVER (PARTITION BY abs_path ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <> 'deleted' AS exists_now FROM log0)"""

EVENTS_SQL = f"""{ROOTS_SQL}, {LOG_SQL},
hit AS (SELECT event_id, arg_max(root, len(string_split(root, '/'))) AS repo_root FROM log JOIN roots ON abs_path = root OR starts_with(abs_path, root || '/') GROUP BY event_id),
ev AS (SELECT log.*, repo_root, coalesce(label, '?') AS repo_label, CASE WHEN repo_root IS NULL THEN abs_path WHEN abs_path = repo_root THEN '.' ELSE substr(abs_path, length(repo_root) + 2) END AS rel_path
  FROM log LEFT JOIN hit USING (event_id) LEFT JOIN roots ON root = repo_root)"""

TREE_SQL = """
tree AS (
  SELECT 'r' || r_regionkey AS symbol_id, NULL::VARCHAR AS parent_id, 'file:///r' || r_regionkey AS uri, r_name AS name, 3 AS kind, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'file:///r' || n_regionkey, n_name, 5, n_nationkey::BIGINT FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'file:///r' || n_regionkey, c_name, 6, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

FACTS_SQL = """
sym AS (
  SELECT 'p' || p_partkey AS symbol_id, p_name AS name, 't' || p_type AS type_id, concat_ws(' ', p_brand, p_name) AS signature, p_type AS doc FROM part
  UNION ALL SELECT DISTINCT 't' || p_type, p_type, NULL, p_type, NULL FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, NULL, s_name, NULL FROM supplier),
occ AS (
  SELECT 'p' || l_partkey AS symbol_id, 'file:///o' || l_orderkey AS uri, l_linenumber AS line, (l_suppkey % 20)::INT AS char_start, (l_suppkey % 20 + 5 + l_partkey % 5)::INT AS char_end, 'reference' AS role FROM lineitem
  UNION ALL SELECT 'p' || p_partkey, 'file:///part/' || p_brand, p_partkey::INT, 0, length(p_name)::INT, 'definition' FROM part
  UNION ALL SELECT DISTINCT 't' || p_type, 'file:///type/' || p_type, 0, 0, length(p_type)::INT, 'definition' FROM part),
preq AS (SELECT p_partkey AS request_id, 'file:///part/' || p_brand AS uri, p_partkey::INT AS line, 0 AS char, 'renamed_' || p_partkey AS new_name FROM part),
lreq AS (SELECT l_orderkey * 100 + l_linenumber AS request_id, 'file:///o' || l_orderkey AS uri, l_linenumber AS line, min((l_suppkey % 20)::INT + 1) AS char FROM lineitem GROUP BY ALL),
spot AS (SELECT request_id, arg_min(symbol_id, {'w': char_end - char_start, 's': char_start, 'n': symbol_id}) AS symbol_id FROM preq JOIN occ USING (uri, line) WHERE char_start <= char AND char < char_end GROUP BY request_id),
lspot AS (SELECT request_id, arg_min(symbol_id, {'w': char_end - char_start, 's': char_start, 'n': symbol_id}) AS symbol_id FROM lreq JOIN occ USING (uri, line) WHERE char_start <= char AND char < char_end GROUP BY request_id),
call AS (SELECT DISTINCT 's' || l_suppkey AS caller_id, 'p' || l_partkey AS callee_id FROM lineitem)"""

PUSH_SQL = """
push AS (SELECT 'file:///u' || user_id AS uri, event_id AS push_seq, (event_id % 4 + 1)::INT AS severity, props AS message,
  CASE WHEN event_id % 5 = 0 THEN []::VARCHAR[] ELSE [props] END AS diagnostics FROM events WHERE event_type = 'error')"""
