"""Queries over change logs: sources, filters, attribution, coalescing, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import paths, text
from weftline.model import WatchConfig
from weftline.operators import attribution, changes, ignore, ignoreindex, intel
from weftline.plans import views
from weftline.session import shared_folder
from weftline.streaming import watch

E, R, L, H = views.EVENTS_SQL, views.ROOTS_SQL, views.LOG_SQL, views.HOST_ROOTS_SQL
QUERIES: dict[str, tuple] = {}
BATCH = ["day"]


def query(sql):
    """Registers a query with its SQL, or a function that gives it (for SQL whose parts stand further below)."""

    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


# Sources and detection


@query(f"""WITH {L}, old AS (SELECT abs_path AS path, max(us) AS mtime, count(*) AS size FROM log WHERE day < DATE '2024-01-08' GROUP BY 1),
new AS (SELECT abs_path AS path, max(us) AS mtime, count(*) AS size FROM log GROUP BY 1 HAVING last(exists_now ORDER BY us))
SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM old FULL JOIN new ON old.path = new.path WHERE (old.mtime, old.size) IS DISTINCT FROM (new.mtime, new.size)""")
def src3_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.sources.snapshots import diff

    log = views.change_log(spark, sf)
    listing = lambda df: df.groupBy(F.col("abs_path").alias("path")).agg(F.max("us").alias("mtime"), F.count("*").alias("size"), F.max_by("exists_now", "us").alias("e"))
    return diff(listing(log.where("day < '2024-01-08'")), listing(log).where("e"))


@query(f"WITH {E} SELECT seq, repo_root, repo_label, rel_path, change FROM ev")
def src1_watch_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming source path: events as a stream, attributed by the same projection, into a Parquet sink."""
    return _streamed(spark, sf)


@query(lambda: f"""WITH {E}, k AS (SELECT * EXCLUDE (exists_now), arg_max(change, seq) OVER (PARTITION BY abs_path) <> 'deleted' AS exists_now FROM ev WHERE {_RULES_SQL}),
c AS ({_COALESCE.format(b='').replace('FROM ev', 'FROM k')}) SELECT (SELECT count(*) FROM k) AS raw, (SELECT count(*) FROM c) AS filtered, repo_root, repo_label, rel_path, change FROM c""")
def src2_watch_async(spark: SparkSession, sf: str) -> DataFrame:
    """The watch query itself: it runs beside its caller, who reads the envelopes that its sink was handed. The stream of paths and
    changes is one batch; what exists is told by each path's last change."""
    folder = _folder(spark)
    stream = _change_stream(spark, sf).select("change", F.col("abs_path").alias("path"))
    known = attribution.labels_of([root for _, root in views.ROOTS])
    cfg = WatchConfig(gitignore_filter=False, repo_custom_ignores={k: tuple(v) for k, v in views.CUSTOM_IGNORES.items()})
    schema = "raw long, filtered long, repo_root string, repo_label string, rel_path string, change string"

    def sink(envelope, number):
        events = envelope.select("raw", "filtered", F.explode("events").alias("e")).select("raw", "filtered", "e.repo_root", "e.repo_label", "e.rel_path", "e.change")
        events.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    running = watch.watch(stream, known, cfg, sink, f"{folder}/state", watch.NOW)
    while running.isActive:
        running.awaitTermination(1)
    if running.exception():
        raise running.exception()
    return spark.read.schema(schema).parquet(f"{folder}/out").select("raw", "filtered", "repo_root", "repo_label", "rel_path", "change")


def _change_stream(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, change, abs_path) of events as a stream."""
    stream = spark.readStream.schema(views.table(spark, sf, "events").schema).option("pathGlobFilter", "*.parquet").parquet(*_stream_path(sf))
    user = F.col("user_id")
    path = F.concat(views.pick(user % 5, views.BASES), F.lit("/d"), user % 7, F.lit("/f"), user, views.pick(user % 3, views.SUFFIXES))
    return stream.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("change"), path.alias("abs_path"))


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    known = attribution.labels_of([root for _, root in views.ROOTS])
    out = attribution.attribute_few(_change_stream(spark, sf), known).select("seq", "repo_root", "repo_label", "rel_path", "change")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _stream_path(sf: str) -> tuple[str]:
    """The events table as a streaming source: its own path with a glob, as a stream reads folders."""
    return (f"{sf}/events.parque[t]",)


# Projections


@query(f"WITH {L} SELECT event_id, CASE change WHEN 'added' THEN 'Created' WHEN 'modified' THEN 'Changed' ELSE 'Deleted' END AS type FROM log")
def prj1_change_type(spark, sf):
    return views.change_log(spark, sf, False).select("event_id", text.file_event_type(F.col("change")).alias("type"))


@query("""SELECT page_id, 'file://' || replace(replace(replace(url_encode(path), '%2F', '/'), '+', '%20'), '%7E', '~') AS uri FROM (SELECT page_id, '/' || regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)""")
def prj2_path_to_uri(spark, sf):
    return views.url_paths(spark, sf).select("page_id", paths.to_uri(F.col("path")).alias("uri"))


@query(f"WITH {E} SELECT seq, 'file://' || abs_path AS uri, CASE change WHEN 'added' THEN 'Created' WHEN 'modified' THEN 'Changed' ELSE 'Deleted' END AS type FROM ev WHERE suffix(abs_path, '.py') OR suffix(abs_path, '.ts')")
def prj3_translate(spark, sf):
    return changes.translate(views.events(spark, sf, False), [".py", ".ts"])


@query(f"WITH {E} SELECT event_id, change, abs_path, repo_root, repo_label, rel_path FROM ev")
def prj4_event_for(spark, sf):
    return views.events(spark, sf, False).select("event_id", "change", "abs_path", "repo_root", "repo_label", "rel_path")


@query(f"WITH {H} SELECT root, base_name FROM roots UNION ALL SELECT '/', '/'")
def prj6_root_label(spark, sf):
    more = views.host_roots(spark, sf).select("root").distinct().union(spark.createDataFrame([("/",)], "root string"))
    return more.select("root", paths.base_name(F.col("root")).alias("base_name"))


@query(f"WITH {E} SELECT event_id, rel_path FROM ev")
def prj7_relative_path(spark, sf):
    return views.events(spark, sf, False).select("event_id", "rel_path")


@query(f"WITH {E} SELECT event_id, rtrim(replace('x\\' || rel_path || '/', '\\', '/'), '/') AS key FROM ev")
def prj8_normalised_key(spark, sf):
    return views.events(spark, sf, False).select("event_id", paths.compare_key(F.concat(F.lit("x\\"), "rel_path", F.lit("/"))).alias("key"))


@query(f"WITH {L} SELECT event_id, rpad(upper(change), 8, ' ') AS label FROM log")
def prj9_change_label(spark, sf):
    return views.change_log(spark, sf, False).select("event_id", text.change_label(F.col("change")).alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS time FROM events")
def prj10_time_label(spark, sf):
    return views.table(spark, sf, "events").select("event_id", text.time_label(F.col("ts")).alias("time"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_brand || ', ' || p_type || ' ,,', ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")
def prj11_split_csv(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", text.split_list(F.concat_ws("", "p_brand", F.lit(", "), "p_type", F.lit(" ,,"))).alias("parts"))


@query(f"WITH {L} SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'markdown' END AS language FROM log")
def prj12_language_kind(spark, sf):
    log = views.change_log(spark, sf, False)
    return log.select("event_id", text.language_kind(views.pick(F.col("user_id") % 3, ("Python", "TypeScript", "MARKDOWN"))).alias("language"))


# Filters


@query(f"WITH {L} SELECT event_id, abs_path FROM log WHERE suffix(abs_path, '.py') OR suffix(abs_path, '.md')")
def flt1_by_suffix(spark, sf):
    return changes.by_suffix(views.change_log(spark, sf, False), [".py", ".md"]).select("event_id", "abs_path")


@query(f"WITH {L} SELECT event_id, abs_path FROM log")
def flt1_no_suffixes(spark, sf):
    return changes.by_suffix(views.change_log(spark, sf, False), []).select("event_id", "abs_path")


_RULES_SQL = """NOT (regexp_full_match(abs_path, '/ws/app/d1/.*\\.py', 's') OR regexp_full_match(abs_path, '/ws/app/d./f1.*', 's')
OR abs_path = '/ws/app/d2' OR starts_with(abs_path, '/ws/app/d2/') OR starts_with(abs_path, '/srv/app/d3/') OR starts_with(abs_path, '/srv/app/d4/') OR starts_with(abs_path, '/srv/app/d[5]/x')
OR regexp_full_match(abs_path, '/data/ml/d6/.*7\\.md', 's'))"""


@query(f"WITH {L} SELECT event_id, abs_path FROM log WHERE {_RULES_SQL}")
def flt2_ignore_rules(spark, sf):
    rules = ignore.build_rules(True, views.CUSTOM_IGNORES)
    return ignore.apply_rules(views.change_log(spark, sf, False), rules).select("event_id", "abs_path")


@query(f"WITH {L} SELECT event_id, regexp_full_match(abs_path, '/ws/app/d1/.*\\.py', 's') OR regexp_full_match(abs_path, '/ws/app/d./f1.*', 's') OR regexp_full_match(abs_path, '/data/ml/d6/.*7\\.md', 's') AS ignored FROM log")
def flt2a_glob_rules(spark, sf):
    rules = [r for r in ignore.build_rules(False, views.CUSTOM_IGNORES) if r[2] == "glob"]
    return views.change_log(spark, sf, False).select("event_id", ignore.matches(F.col("abs_path"), rules).alias("ignored"))


@query(f"WITH {L} SELECT event_id, abs_path FROM log WHERE NOT (starts_with(abs_path, '/ws/app/d2/') OR starts_with(abs_path, '/srv/app/d3/') OR starts_with(abs_path, '/srv/app/d4/'))")
def flt2b_path_rules(spark, sf):
    rules = ignore.rules_table(spark, [r for r in ignore.build_rules(False, views.CUSTOM_IGNORES) if r[2] == "path"])
    return ignore.apply_path_rules(views.change_log(spark, sf, False), rules).select("event_id", "abs_path")


@query("SELECT p_type AS value, min(p_partkey) AS seq FROM part GROUP BY 1")
def flt2c_unique_in_order(spark, sf):
    rules = views.table(spark, sf, "part").select(F.lit("path").alias("kind"), F.col("p_type").alias("value"), F.col("p_partkey").alias("seq"))
    return ignore.unique_rules(rules).select("value", "seq")


@query("SELECT n || '/x' || p_partkey AS path FROM part, (VALUES ('/a/.git'), ('/a/src'), ('/a/node_modules/b')) t(n) WHERE n = '/a/src'")
def flt2d_default_rules(spark, sf):
    names = spark.createDataFrame([("/a/.git",), ("/a/src",), ("/a/node_modules/b",)], "n string")
    every = views.table(spark, sf, "part").crossJoin(F.broadcast(names)).select(F.concat("n", F.lit("/x"), "p_partkey").alias("path"))  # three fixed rows
    return ignore.apply_rules(every, ignore.build_rules(True, {}), "path")


_ASKED = r"""(SELECT event_id FROM ev WHERE (repo_root = '/ws/app' AND (starts_with(rel_path, 'd5/') OR (regexp_full_match(rel_path, '(.*/)?f[^/]*0\.py') AND NOT starts_with(rel_path, 'd3/'))))
OR (repo_root = '/srv/app' AND regexp_full_match(rel_path, 'd2/[^/]*\.md|(.*/)?f[^/]*2\.md')))"""


@query(f"WITH {E} SELECT event_id, repo_root, rel_path FROM ev WHERE event_id NOT IN (SELECT event_id FROM {_ASKED})")
def flt3_gitignore(spark, sf):
    """Native mode: the lines of ignore files as rows, with order, negation and anchors, and a root whose check failed keeps all."""
    ev = views.events(spark, sf, False)
    ignored, _ = _ignored(spark, ev)
    return ignore.drop_ignored(ev, ignored).select("event_id", "repo_root", "rel_path")


def _ignored(spark, ev):
    root_ok = spark.createDataFrame([(r, True) for r in ("/ws/app", "/srv/app", "/data/ml")] + [("/ws/app/lib", False)], "repo_root string, root_ok boolean")
    asked = ignore.requests(ev, root_ok, 4000)
    rules = spark.createDataFrame([r for root, lines in views.IGNORE_FILES.items() for r in ignore.git_rules(root, lines)], ignore.GIT_RULE)
    failed = spark.createDataFrame([(views.FAILED_ROOT, "timed out")], "repo_root string, error string")
    return ignore.fail_open(ignore.ignored_by_rules(asked, rules), failed)


@query(f"WITH {H} SELECT root AS repo_root, 'gitignore filtering failed for ' || root || ': ' || min('timed out at ' || ord) || ' (fail-open)' AS warning FROM r0 WHERE ord % 4 = 0 GROUP BY root")
def flt3f_fail_open_warning(spark, sf):
    """A warning for each of the pages' roots that a check failed for: that of every fourth page did."""
    roots = views.host_roots(spark, sf).withColumnRenamed("root", "repo_root")
    failed = roots.where(F.col("ord") % 4 == 0).select("repo_root", F.concat(F.lit("timed out at "), "ord").alias("error"))
    return ignore.fail_open(roots, failed)[1]


#: Ignore files of a tree: the root's, and one in each folder of the log, which its number tells apart.
_ROOT_LINES = "*.md\n!keep*\nd3/\n"
_FOLDER_LINES = "f*{k}.ts\n!f1*\n/f2*.py\n/gone\n"


@query(f"""WITH {E}, p AS (SELECT DISTINCT repo_root, rel_path, split_part(rel_path, '/', 1) AS folder, split_part(rel_path, '/', 2) AS name FROM ev WHERE repo_root IN ('/ws/app', '/srv/app', '/ws/app/lib'))
SELECT repo_root, rel_path AS rel_key FROM p WHERE folder = 'd3' OR CASE WHEN starts_with(name, 'f2') AND suffix(name, '.py') THEN TRUE WHEN starts_with(name, 'f1') THEN FALSE
  WHEN starts_with(name, 'f') AND suffix(name, substr(folder, 2) || '.ts') THEN TRUE ELSE suffix(name, '.md') END""")
def flt3_nested_ignore_files(spark, sf):
    """Paths that the ignore files of whole trees leave out: the deepest folder's rules come last, and nothing below an ignored
    folder is taken back."""
    from weftline.sources import ignorefiles

    ev = views.events(spark, sf, False).where(F.col("repo_root").isin("/ws/app", "/srv/app", "/ws/app/lib"))
    folders = ev.select("repo_root", F.split("rel_path", "/")[0].alias("folder")).distinct()
    lines = F.replace(F.lit(_FOLDER_LINES), F.lit("{k}"), F.substr("folder", F.lit(2)))
    files = folders.select("repo_root", "folder", lines.alias("text"), F.lit(False).alias("excludes"))
    roots = folders.select("repo_root").distinct().select("repo_root", F.lit("").alias("folder"), F.lit(_ROOT_LINES).alias("text"), F.lit(False).alias("excludes"))
    return ignorefiles.ignored(ignoreindex.asked_of(ev), files.unionByName(roots)).select("repo_root", "rel_key")


@query(f"""WITH {E}, p AS (SELECT DISTINCT repo_root, rel_path, split_part(rel_path, '/', 1) AS folder, split_part(rel_path, '/', 2) AS name FROM ev WHERE repo_root IN ('/ws/app', '/srv/app')),
c AS (SELECT c_custkey AS k, c_custkey % 4 = 0 AS negated FROM customer),
m AS (SELECT repo_root, rel_path, k, negated FROM p JOIN c ON k % 3 = 0 AND name = 'f' || k || '.py' UNION ALL SELECT repo_root, rel_path, k, negated FROM p JOIN c ON k % 3 = 1 AND suffix(name, k || '.ts')
  UNION ALL SELECT repo_root, rel_path, k, negated FROM p JOIN c ON k % 3 = 2 AND folder = 'd' || k % 7 AND starts_with(name, 'f' || k))
SELECT repo_root, rel_path AS rel_key FROM m GROUP BY ALL HAVING NOT arg_max(negated, k)""")
def flt3_rule_index(spark, sf):
    """A rule for each customer (names, ends of names, beginnings within a folder, every fourth one negated), in one ignore file of two
    roots."""
    from weftline.sources import ignorefiles

    k = F.col("c_custkey")
    glob = F.when(k % 3 == 0, F.concat(F.lit("f"), k, F.lit(".py"))).when(k % 3 == 1, F.concat(F.lit("*"), k, F.lit(".ts"))).otherwise(F.concat(F.lit("/d"), k % 7, F.lit("/f"), k, F.lit("*")))
    rule = views.table(spark, sf, "customer").select(k.alias("k"), F.concat(F.when(k % 4 == 0, "!").otherwise(""), glob).alias("line"))
    # a file for each thousand lines, in order of its excludes' precedence
    lines = rule.groupBy(F.floor(F.col("k") / 1000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("rows"))
    text = lines.select("part", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"), F.lit(True).alias("excludes"))
    ev = views.events(spark, sf, False).where(F.col("repo_root").isin("/ws/app", "/srv/app"))
    files = ev.select("repo_root").distinct().crossJoin(F.broadcast(text)).select("repo_root", F.lit("").alias("folder"), "text", "excludes", "part")  # two roots
    rules = ignorefiles.rules_of(files, "part")
    return ignoreindex.ignored(ignoreindex.asked_of(ev), rules).select("repo_root", "rel_key")


@query(f"WITH {E}, a AS (SELECT repo_root, seq, rel_path AS asked FROM ev WHERE repo_root IN ('/ws/app', '/srv/app') UNION ALL SELECT repo_root, seq, rel_path || '/' FROM ev WHERE repo_root IN ('/ws/app', '/srv/app') AND change = 'deleted') SELECT repo_root, asked, count(*) AS n, TRUE AS small_chunks FROM a GROUP BY ALL")
def flt3a_git_requests(spark, sf):
    root_ok = spark.createDataFrame([("/ws/app", True), ("/srv/app", True), ("/data/ml", False)], "repo_root string, root_ok boolean")
    asked = ignore.requests(views.events(spark, sf, False), root_ok, 500)
    chunks = asked.groupBy("repo_root", "chunk").count().groupBy("repo_root").agg((F.max("count") <= 500).alias("small_chunks"))
    return asked.groupBy("repo_root", "asked").agg(F.count("*").alias("n")).join(chunks, "repo_root")


@query(f"WITH {H} SELECT mode, root, FALSE AS root_ok FROM roots, (VALUES ('on'), ('off')) t(mode)")
def flt3c_gitignore_status(spark, sf):
    """With the filter on and off: none of the pages' roots is a work tree here, so each is told so by git (or by its absence)."""
    roots = views.host_roots(spark, sf)
    on, off = (ignore.statuses(roots, on).withColumn("mode", F.lit("on" if on else "off")) for on in (True, False))
    return on.union(off).select("mode", "root", "root_ok")


@query("SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS supported, FALSE AS other FROM events GROUP BY 1")
def flt4_supports(spark, sf):
    caps = views.table(spark, sf, "events").groupBy("user_id").agg(F.array_distinct(F.collect_list("event_type")).alias("names"))
    caps = caps.select("user_id", F.map_from_arrays("names", F.transform("names", lambda _: F.lit(True))).alias("caps"))
    return caps.select("user_id", text.supports(F.col("caps"), "purchase").alias("supported"), text.supports(F.col("caps"), "rename").alias("other"))


@query(f"WITH {H} SELECT ord, root FROM r0")
def flt5_valid_roots(spark, sf):
    roots = views.host_roots(spark, sf)
    known = roots.select(F.col("root").alias("path"), F.lit(True).alias("is_dir")).distinct()
    return attribution.check_roots(roots, known).select("ord", "root")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN c_custkey % 3 END AS n_suffixes, CASE WHEN c_custkey % 10 > 0 THEN 'ls' || c_custkey % 4 END AS server,
CASE WHEN c_custkey % 10 = 0 THEN 'language ' || c_name || ' has no server' END AS problem FROM customer""")
def flt6_valid_languages(spark, sf):
    """A language of each customer's: valid, or what is wrong with it."""
    return views.each_row(views.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey long, n_suffixes long, server string, problem string", _language)


def _language(k, name):
    from weftline.sources.languages import parse_languages

    entry = {"name": name, "suffixes": [".py", ".pyi"][: k % 3]} | ({"server": f"ls{k % 4}"} if k % 10 else {})
    try:
        return [(k, len(suffixes), server, None) for _, suffixes, server, _ in parse_languages({"language": [entry]})]
    except ValueError as e:
        return [(k, None, None, str(e))]


@query(f"WITH {L} SELECT seq FROM log WHERE suffix(abs_path, '.rs')")
def flt7_no_op_batch(spark, sf):
    return changes.translate(views.change_log(spark, sf, False), [".rs"]).select("seq")


# Joins


@query(f"WITH {E} SELECT event_id, repo_root, repo_label, rel_path FROM ev")
def jn1_attribute(spark, sf):
    """Paths to their deepest root, by equality on exploded ancestors."""
    return attribution.attribute(views.change_log(spark, sf, False), attribution.normalize_roots(views.roots(spark))).select("event_id", "repo_root", "repo_label", "rel_path")


@query("""WITH p AS (SELECT page_id, '/' || regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages),
r AS (SELECT DISTINCT '/' || string_split(path, '/')[2] AS root FROM p UNION SELECT DISTINCT '/' || string_split(path, '/')[2] || '/en' FROM p WHERE string_split(path, '/')[3] = 'en')
SELECT page_id, arg_max(root, length(root)) AS repo_root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def jn1_attribute_urls(spark, sf):
    """Attribution with many roots: each host, and its English part."""
    p = views.url_paths(spark, sf)
    part = F.split("path", "/")
    hosts = p.select(F.concat(F.lit("/"), F.get(part, 1)).alias("root")).union(p.where(F.get(part, 2) == "en").select(F.concat(F.lit("/"), F.get(part, 1), F.lit("/en")))).distinct()
    return attribution.attribute(p, hosts.withColumn("label", F.col("root")), "path").where("repo_root is not null").select("page_id", "repo_root")


@query(f"WITH {E} SELECT event_id, repo_root, repo_label, rel_path FROM ev")
def jn1_attribute_theta(spark, sf):
    """The same by the containment join itself, over the fixed list of roots."""
    return attribution.attribute_theta(views.change_log(spark, sf, False), attribution.normalize_roots(views.roots(spark))).select("event_id", "repo_root", "repo_label", "rel_path")


@query(f"WITH {E} SELECT event_id, repo_label, rel_path FROM ev WHERE repo_root IS NULL")
def jn1n_outside(spark, sf):
    return views.events(spark, sf, False).where("repo_root is null").select("event_id", "repo_label", "rel_path")


@query(f"WITH {H} SELECT a.root AS outer_root, b.root AS inner_root FROM roots a JOIN roots b ON a.root <> b.root AND starts_with(b.root, a.root || '/')")
def jn2_nested_roots(spark, sf):
    return attribution.nested_pairs(attribution.normalize_roots(views.host_roots(spark, sf)))


@query(f"WITH {E} SELECT repo_root, repo_label, count(*) AS n FROM ev GROUP BY ALL")
def jn3_labels(spark, sf):
    ev = views.events(spark, sf, False).select("repo_root")
    labels = F.broadcast(attribution.normalize_roots(views.roots(spark)).select(F.col("root").alias("repo_root"), "label"))
    return ev.join(labels, "repo_root", "left").groupBy("repo_root", F.coalesce("label", F.lit("?")).alias("repo_label")).agg(F.count("*").alias("n"))


@query(f"WITH {E}, ign AS (SELECT DISTINCT repo_root, rel_path FROM ev WHERE change = 'deleted' AND repo_root IS NOT NULL) SELECT event_id FROM ev ANTI JOIN ign ON ev.repo_root = ign.repo_root AND ev.rel_path = ign.rel_path")
def jn4_anti_ignored(spark, sf):
    ev = views.events(spark, sf, False)
    ignored = ev.where("change = 'deleted'").select("repo_root", paths.compare_key(F.col("rel_path")).alias("rel_key")).distinct()
    return ignore.drop_ignored(ev, ignored).select("event_id")


@query(f"WITH {L} SELECT event_id, exists_now FROM log")
def jn5_exists(spark, sf):
    log = views.change_log(spark, sf)
    snapshot = log.where("exists_now").select(F.col("abs_path").alias("path")).distinct()
    return changes.with_existence(log.drop("exists_now"), snapshot).select("event_id", "exists_now")


@query(f"WITH {L}, lang AS (SELECT * FROM (VALUES ('python', ['.py', '.pyi']), ('typescript', ['.ts', '.tsx']), ('any', []::VARCHAR[])) t(language, suffixes)) SELECT event_id, language FROM log JOIN lang ON len(suffixes) = 0 OR len(list_filter(suffixes, lambda s: suffix(abs_path, s))) > 0")
def jn6_route(spark, sf):
    languages = spark.createDataFrame(list(views.LANGUAGES), "name string, suffixes array<string>")
    return changes.route(views.change_log(spark, sf, False), languages).select("event_id", "language")


# Aggregates, windows and order

_COALESCE = """SELECT {b}repo_root, rel_path, abs_path, arg_max(repo_label, seq) AS repo_label, min(seq) AS seq,
CASE WHEN bool_or(change = 'deleted') AND NOT bool_or(change = 'added') THEN 'deleted' WHEN bool_or(change = 'added') AND NOT bool_or(change = 'deleted') THEN 'added'
WHEN bool_or(change = 'added') AND NOT bool_or(exists_now) THEN 'deleted' ELSE 'modified' END AS change FROM ev GROUP BY {b}repo_root, rel_path, abs_path"""


@query(f"WITH {E} {_COALESCE.format(b='day, ')}")
def agg1_coalesce_events(spark, sf):
    """One final change for each path and day."""
    return changes.coalesce(views.events(spark, sf), BATCH)


@query(f"""WITH {E}, f AS (SELECT day, repo_root, rel_path, abs_path, max(CASE change WHEN 'added' THEN 'A' ELSE '' END) || max(CASE change WHEN 'deleted' THEN 'D' ELSE '' END) || max(CASE change WHEN 'modified' THEN 'M' ELSE '' END) AS seen FROM ev GROUP BY ALL) SELECT seen, count(*) AS n FROM f GROUP BY 1""")
def agg1_flag_sets(spark, sf):
    return changes.flags(views.events(spark, sf, False), BATCH).groupBy("seen").agg(F.count("*").alias("n"))


_HEAD = f"""WITH {E}, kept AS (SELECT * FROM ev WHERE {_RULES_SQL}), c AS ({_COALESCE.format(b='day, ').replace('FROM ev', 'FROM kept')}),
raw AS (SELECT day, count(*) AS raw FROM kept GROUP BY 1), n AS (SELECT day, count(*) AS filtered FROM c GROUP BY 1)"""


def _final(spark, sf):
    """What the rules leave, and the final events; only the latter need to know what exists."""
    rules = ignore.build_rules(True, views.CUSTOM_IGNORES)
    return ignore.apply_rules(views.change_log(spark, sf, False), rules), changes.coalesce(ignore.apply_rules(views.events(spark, sf), rules), BATCH)


@query(f"WITH {L} SELECT day, count(*) AS raw FROM log WHERE {_RULES_SQL} GROUP BY 1")
def agg2_raw_count(spark, sf):
    """Changes of each day that the ignore rules leave."""
    kept = ignore.apply_rules(views.change_log(spark, sf, False), ignore.build_rules(True, views.CUSTOM_IGNORES))
    return changes.raw_counts(kept, BATCH)


@query(f"{_HEAD} SELECT day, raw, coalesce(filtered, 0) AS filtered FROM raw LEFT JOIN n USING (day)")
def agg3_batch_headers(spark, sf):
    return changes.headers(*_final(spark, sf), BATCH)


@query(f"WITH {H} SELECT base_name, count(*) AS n FROM roots GROUP BY 1")
def agg4_base_names(spark, sf):
    return attribution.normalize_roots(views.host_roots(spark, sf)).groupBy("base_name").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT repo_root, list(DISTINCT rel_path ORDER BY rel_path) AS rel_paths FROM ev WHERE change = 'added' GROUP BY 1")
def agg5_paths_by_root(spark, sf):
    ev = views.events(spark, sf, False).where("change = 'added'")
    return changes.paths_by_root(ev)


@query(f"""{_HEAD}, l AS (SELECT day, list(change || ' ' || abs_path ORDER BY seq) AS events FROM c GROUP BY 1)
SELECT day, raw, coalesce(filtered, 0) AS filtered, coalesce(events, []) AS events FROM raw LEFT JOIN n USING (day) LEFT JOIN l USING (day)""")
def agg6_envelopes(spark, sf):
    ev, final = _final(spark, sf)
    env = changes.envelopes(changes.headers(ev, final, BATCH), final, BATCH)
    return env.select("day", "raw", "filtered", F.transform("events", lambda x: F.concat(x["change"], F.lit(" "), x["abs_path"])).alias("events"))


@query(f"WITH {H} SELECT ord, root, base_name, label FROM roots")
def win1_labels(spark, sf):
    return attribution.normalize_roots(views.host_roots(spark, sf))


@query(f"WITH {H} SELECT ord, root FROM r1")
def win2_first_roots(spark, sf):
    return attribution.normalize_roots(views.host_roots(spark, sf)).select("ord", "root")


@query(f"WITH {E} SELECT abs_path, min(seq) AS first_seq, arg_max(change, seq) AS last_change FROM ev GROUP BY 1")
def win3_first_and_last(spark, sf):
    return changes.first_and_last(views.events(spark, sf, False), ["abs_path"])


@query(f"WITH {L} SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4)::INT AS chunk FROM log")
def win5_chunks(spark, sf):
    return changes.chunks(views.change_log(spark, sf, False), "user_id", "event_id", 4).select("user_id", "event_id", "chunk")


@query(f"WITH {E} SELECT repo_label, rel_path, change, rpad(upper(change), 8, ' ') || '  [' || repo_label || '] ' || rel_path AS line FROM ev ORDER BY 1, 2")
def srt1_sorted_report(spark, sf):
    return changes.printed(views.events(spark, sf, False))


@query("SELECT p_type, list(DISTINCT p_brand ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def srt2_sorted_names(spark, sf):
    return intel.sorted_names(views.table(spark, sf, "part"), "p_type", "p_brand", "brands")


@query(f"WITH {E} SELECT repo_root, arg_max(abs_path, {{'n': len(string_split(abs_path, '/')), 'p': abs_path}}) AS deepest FROM ev GROUP BY 1")
def top1_deepest(spark, sf):
    return attribution.deepest(views.events(spark, sf, False), ["repo_root"])


@query("SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part WHERE p_size > 25 GROUP BY 1")
def top2_first_match(spark, sf):
    """Of each brand the first part, by key, that matches."""
    p = views.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size")
    return intel.first_where(p, F.col("p_size") > 25, ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query("SELECT s_nationkey, arg_min(s_name, {'b': -s_acctbal, 'k': s_suppkey}) AS s_name FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def top3_first_usable(spark, sf):
    """The first candidate that can be used, in order of preference."""
    s = views.table(spark, sf, "supplier").withColumn("less", -F.col("s_acctbal"))
    return intel.first_where(s, F.col("s_acctbal") > 0, ["s_nationkey"], ["less", "s_suppkey"]).select("s_nationkey", "s_name")


@query("SELECT page_id, list_last(regexp_extract_all(url, '[a-z]+')) AS word FROM pages")
def top4_last_match(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.last_match(F.col("url"), "[a-z]+").alias("word"))


# Set operations


@query("SELECT p_type AS value FROM part UNION SELECT p_brand FROM part")
def set1_rule_union(spark, sf):
    p = views.table(spark, sf, "part")
    rules = lambda c, seq: p.select(F.lit("path").alias("kind"), F.col(c).alias("value"), F.lit(seq).alias("seq"))
    return ignore.merged_rules(rules("p_type", 0), rules("p_brand", 1)).select("value")


@query(f"WITH {E} SELECT DISTINCT repo_root, rel_path FROM ev WHERE change = 'deleted' UNION SELECT DISTINCT repo_root, rel_path FROM ev WHERE change = 'added'")
def set2_union_of_chunks(spark, sf):
    ev = views.events(spark, sf, False)
    return ignore.union_of_chunks(ev.where("change = 'deleted'"), ev.where("change = 'added'"))


@query(f"WITH {L} SELECT DISTINCT day, abs_path FROM log l WHERE change <> 'deleted' AND NOT EXISTS (SELECT 1 FROM log d WHERE d.day = l.day AND d.abs_path = l.abs_path AND d.change = 'deleted')")
def set3_difference(spark, sf):
    """Paths that a day has touched without deleting them."""
    log = views.change_log(spark, sf, False)
    return changes.paths_without(log, "deleted", BATCH)


@query("WITH a AS (SELECT p_type, list(DISTINCT p_brand) AS own FROM part GROUP BY 1), b AS (SELECT list(DISTINCT p_brand) AS every FROM part WHERE p_size < 5 AND p_partkey % 3 = 0) SELECT p_type, list_sort(list_filter(own, lambda x: NOT list_contains(every, x))) AS missing FROM a, b")
def set4_missing_names(spark, sf):
    p = views.table(spark, sf, "part")
    return intel.missing_names(p, p.where("p_size < 5 and p_partkey % 3 = 0"), "p_type", "p_brand")


@query(f"WITH {L} SELECT event_id, abs_path FROM log")
def set5_merged_roots(spark, sf):
    """One stream of several roots' changes: the union of each root's own, every change once, and of those outside all roots."""
    log = views.events(spark, sf, False).select("event_id", "abs_path", "repo_root")
    known = [root for root, _ in attribution.labels_of([root for _, root in views.ROOTS])]
    return changes.merged([log.where(F.col("repo_root") == r) for r in known] + [log.where("repo_root is null")]).select("event_id", "abs_path")


# Batches in time

_SESSIONS = f"""WITH RECURSIVE {L}, o AS (SELECT user_id, us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM log),
s AS (SELECT user_id, us, event_id, k, us AS batch_start FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.us, o.event_id, o.k, CASE WHEN o.us - s.us > {views.GAP} OR o.us - s.batch_start >= {views.CAP} THEN o.us ELSE s.batch_start END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)"""


@query(f"{_SESSIONS} SELECT event_id, user_id, batch_start FROM s")
def st1_capped_batches(spark, sf):
    log = views.change_log(spark, sf, False).select("event_id", "user_id", "us")
    return changes.capped_batches(log, "user_id", "us", "event_id", views.GAP, views.CAP).select("event_id", "user_id", "batch_start")


@query(f"{_SESSIONS} SELECT event_id, user_id, batch_start FROM s")
def st1_capped_batches_stream(spark, sf):
    """The streaming twin, with a key's running batch as state."""
    schema, folder = views.table(spark, sf, "events").schema, _folder(spark)
    stream = spark.readStream.schema(schema).parquet(*_stream_path(sf)).select("event_id", "user_id", changes.micros(F.col("ts")).alias("us"))
    out = watch.capped_batches_stream(stream, "user_id", "us", "event_id", views.GAP, views.CAP).select("event_id", "user_id", "batch_start")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(f"{_SESSIONS}, b AS (SELECT user_id, batch_start, count(*) AS raw FROM s GROUP BY ALL), k AS (SELECT user_id, batch_start, count(*) AS filtered FROM s JOIN log USING (event_id, user_id) WHERE suffix(abs_path, '.py') GROUP BY ALL) SELECT user_id, batch_start, raw, coalesce(filtered, 0) AS filtered FROM b LEFT JOIN k USING (user_id, batch_start)")
def st6_empty_batches(spark, sf):
    """Batches that a filter empties keep their header."""
    log = views.change_log(spark, sf, False).select("event_id", "user_id", "us", "abs_path")
    batched = changes.capped_batches(log, "user_id", "us", "event_id", views.GAP, views.CAP)
    return changes.headers(batched, changes.by_suffix(batched, [".py"]), ["user_id", "batch_start"])


@query(f"WITH {E}, k AS (SELECT * FROM ev WHERE {_RULES_SQL}) {_COALESCE.format(b='').replace('FROM ev', 'FROM k')}")
def ent1_whole_path(spark, sf):
    """The startup plan's rules, attribution and coalescing as one pass without batches."""
    raw = views.change_log(spark, sf).withColumnRenamed("abs_path", "path")
    known = attribution.labels_of([root for _, root in views.ROOTS])
    cfg = WatchConfig(gitignore_filter=False, repo_custom_ignores={k: tuple(v) for k, v in views.CUSTOM_IGNORES.items()})
    return watch.prepare(raw, known, cfg)[0]
