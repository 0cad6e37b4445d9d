"""The scalar functions, each over every row of a change log or another table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from weftline.functions import paths, text
from weftline.plans import views

A = "abs_path"


def _p():
    return F.col(A)


#: name, Spark expression, SQL expression: over the change log's columns.
LOG_SCALARS = [
    ("scl1_endswith", lambda: F.endswith(_p(), F.lit(".py")), "suffix(abs_path, '.py')"),
    ("scl2_startswith", lambda: F.startswith(_p(), F.lit("/ws/app/")), "starts_with(abs_path, '/ws/app/')"),
    ("scl3_replace", lambda: F.replace(_p(), F.lit("/"), F.lit("\\")), "replace(abs_path, '/', '\\')"),
    ("scl4_rtrim_slashes", lambda: paths.compare_key(F.concat(_p(), F.lit("//"))), "rtrim(abs_path || '//', '/')"),
    ("scl5_trim_lower", lambda: F.lower(F.trim(F.concat(F.lit("  "), F.upper(_p()), F.lit(" ")))), "lower(trim('  ' || upper(abs_path) || ' '))"),
    ("scl6_split", lambda: paths.parts(_p()), "string_split(abs_path, '/')"),
    ("scl7_join", lambda: paths.joined(_p(), "|"), "array_to_string(string_split(abs_path, '/'), '|')"),
    ("scl8_contains", lambda: F.contains(_p(), F.lit("/d3/")), "contains(abs_path, '/d3/')"),
    ("scl9_find", lambda: text.position(_p(), "/f"), "(instr(abs_path, '/f') - 1)::INT"),
    ("scl10_format", lambda: text.format_tag(F.col("change"), F.col("user_id")), "change || '#' || user_id"),
    ("scl11_escape", lambda: paths.without_suffix(_p(), ".py", "_"), "regexp_replace(abs_path, '\\.py$', '_')"),
    ("scl12_glob", lambda: paths.matches_glob(_p(), "*/d?/f1*"), "regexp_full_match(abs_path, '.*/d./f1.*', 's')"),
    ("scl13_last_match", lambda: text.last_match(_p(), "[0-9]+"), "list_last(regexp_extract_all(abs_path, '[0-9]+'))"),
    ("scl14_resolved", lambda: paths.resolved(F.when(F.col("user_id") % 2 == 0, F.ltrim(_p(), F.lit("/"))).otherwise(_p()), "/base"), "CASE WHEN user_id % 2 = 0 THEN '/base' || abs_path ELSE abs_path END"),
    ("scl15_parts", lambda: F.struct(paths.depth(_p()).alias("n"), paths.base_name(_p()).alias("name"))["name"], "list_last(string_split(abs_path, '/'))"),
    ("scl15_under", lambda: paths.is_under(_p(), F.lit("/ws/app")), "abs_path = '/ws/app' OR starts_with(abs_path, '/ws/app/')"),
    ("scl16_absolute", lambda: paths.is_absolute(_p()), "starts_with(abs_path, '/')"),
    ("scl17_uri", lambda: paths.to_uri(F.concat(_p(), F.lit(" é+*~%#?"))), "'file://' || abs_path || '%20%C3%A9%2B%2A~%25%23%3F'"),
    ("scl20_arithmetic", lambda: F.floor((F.col("event_id") + 1) / 4).cast("long"), "(event_id + 1) // 4"),
    ("scl21_exists", lambda: paths.has_suffix(_p(), (".py", ".ts")), "suffix(abs_path, '.py') OR suffix(abs_path, '.ts')"),
    ("scl21_filter", lambda: paths.named_parts(_p()), "list_filter(string_split(abs_path, '/'), lambda x: x <> '')"),
    ("scl22_slice_size", lambda: F.size(F.slice(paths.parts(_p()), 2, 2)), "len(list_slice(string_split(abs_path, '/'), 2, 3))::INT"),
    ("scl23_ordered_distinct", lambda: F.array_distinct(F.concat(paths.parts(_p()), paths.parts(_p()))), "string_split(abs_path, '/')"),
    ("scl24_map_get", lambda: text.number_of(F.col("change"), {"added": 1, "deleted": 3}), "CASE change WHEN 'added' THEN 1 WHEN 'deleted' THEN 3 ELSE 0 END"),
    ("scl26_enum_number", lambda: text.change_number(F.col("change")), "CASE change WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END"),
    ("scl27_raise_error", lambda: text.known(F.col("change"), ("added", "modified", "deleted"), "change"), "change"),
]

#: The same over the columns of events.
EVENT_SCALARS = [
    ("scl18_now", lambda: F.localtimestamp() > F.col("ts"), "TRUE"),
    ("scl19_strftime", lambda: text.time_label(F.col("ts")), "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"),
    ("scl25_json", lambda: text.json_int(F.col("props"), "$.k"), "json_extract(props, '$.k')::INT"),
]


def _query(source: str, expression, spark, sf):
    rows = views.change_log(spark, sf, False) if source == "log" else views.table(spark, sf, "events")
    return rows.select("event_id", expression().alias("value"))


def _named(name: str, source: str, expression):
    f = partial(_query, source, expression)
    f.__name__ = name
    return f


QUERIES = {n: (_named(n, "log", e), f"WITH {views.LOG_SQL} SELECT event_id, {sql} AS value FROM log") for n, e, sql in LOG_SCALARS}
QUERIES |= {n: (_named(n, "events", e), f"SELECT event_id, {sql} AS value FROM events") for n, e, sql in EVENT_SCALARS}
