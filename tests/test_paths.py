"""Attribution, labels, URIs and globs on adversarial paths."""

from pathlib import PurePosixPath

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.operators import attribution

ROOTS = [(1, "/a/outer"), (2, "/a/outer/in"), (3, "/b/outer"), (4, "/a/outer"), (5, "/c")]
PATHS = ["/a/outer", "/a/outer/x", "/a/outerX/x", "/a/outer/in", "/a/outer/in/y z", "/a/outer/inner", "/b/outer/é#%?", "/c/d\n", "/", "/zzz", "/c"]


def roots(spark, rows=ROOTS):
    return attribution.normalize_roots(spark.createDataFrame(rows, "ord int, root string"))


def expected(path, known):
    best = [r for r in known if PurePosixPath(path).is_relative_to(r)]
    if not best:
        return None, "?", path
    root = max(best, key=lambda r: len(PurePosixPath(r).parts))
    return root, known[root], str(PurePosixPath(path).relative_to(root))


@pytest.mark.parametrize("extra", [[], [(6, "/")]])
def test_three_plans_agree_with_the_definition(spark, extra):
    dim = roots(spark, ROOTS + extra)
    known = {r["root"]: r["label"] for r in dim.collect()}
    events = spark.createDataFrame(list(enumerate(PATHS)), "event_id int, abs_path string")
    want = {k: expected(p, known) for k, p in enumerate(PATHS)}
    few = [(r, label) for r, label in known.items()]
    for df in (attribution.attribute(events, dim), attribution.attribute_few(events, few), attribution.attribute_theta(events, dim)):
        assert {r["event_id"]: (r["repo_root"], r["repo_label"], r["rel_path"]) for r in df.collect()} == want


def test_labels_and_nested(spark):
    dim = roots(spark)
    assert [(r["root"], r["label"]) for r in dim.orderBy("ord").collect()] == [("/a/outer", "outer#1"), ("/a/outer/in", "in"), ("/b/outer", "outer#2"), ("/c", "c")]
    assert [tuple(r) for r in attribution.nested_pairs(dim).collect()] == [("/a/outer", "/a/outer/in")]


def test_invalid_root(spark):
    known = spark.createDataFrame([("/a", True), ("/f", False)], "path string, is_dir boolean")
    assert attribution.check_roots(spark.createDataFrame([(1, "/a")], "ord int, root string"), known).count() == 1
    for bad in ("/f", "/missing"):
        with pytest.raises(PySparkException, match="not a directory"):
            attribution.check_roots(spark.createDataFrame([(1, bad)], "ord int, root string"), known).collect()


def test_uri(spark):
    for p in ["/a b/c", "/a+b", "/é~*%#?", "/it's\"x\"", "/&=,;:@!$()[]"]:
        got = spark.createDataFrame([(p,)], "p string").select(paths.to_uri(F.col("p"))).first()[0]
        from urllib.parse import unquote

        assert unquote(got) == "file://" + p and " " not in got and "+" not in got


@pytest.mark.parametrize("glob,text,want", [("*.log", "a.log", True), ("*.log", "a/b.log", True), ("*.log", "a.log\n", False), ("?.py", "ab.py", False), ("a*b*c", "a/x/b/y/c", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("[x", "[x", True), ("a.b", "axb", False)])
def test_glob(spark, glob, text, want):
    rx = "(?s)^" + paths.glob_to_regex(glob) + r"\z"
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(rx)).first()[0] is want


def test_labels_without_a_job_are_those_of_the_table(spark):
    from weftline.operators import attribution

    for roots in (["/a/x", "/b/x", "/a/x", "/c"], ["/"], ["/w/app", "/w/app/lib", "/s/app"], []):
        table = spark.createDataFrame(list(enumerate(roots)), "ord int, root string")
        want = [(r["root"], r["label"]) for r in attribution.normalize_roots(table).orderBy("ord").collect()]
        assert attribution.labels_of(roots) == want
