"""Ignore rules and version-control filtering."""

import subprocess

from pyspark.sql import functions as F

from weftline.operators import ignore

EVENT = "seq long, change string, abs_path string, repo_root string, rel_path string, is_dir boolean"


def events(spark, rows):
    return spark.createDataFrame([(k, c, f"{r or ''}/{p}", r, p, d) for k, (c, r, p, d) in enumerate(rows)], EVENT)


def kept(df):
    return sorted(r["rel_path"] for r in df.collect())


def test_four_ways():
    assert ignore.build_rules(False, {}) is None
    stock = ignore.build_rules(True, {})
    assert len(stock) == len(ignore.DEFAULT_DIRS) + len(ignore.DEFAULT_NAMES) and (None, 1, "dir", ".git") in stock
    both = ignore.build_rules(True, {"/r": ["*.tmp", "build"]})
    assert len(both) == len(stock) + 2
    own = ignore.build_rules(False, {"/r": ["*.tmp", "build", "/abs/x", "build", "[x"]})
    assert [r[2:] for r in own] == [("glob", r"^/r/.*\.tmp\z"), ("path", "/r/build"), ("path", "/abs/x"), ("path", "/r/[x")]


def test_matching(spark):
    rules = ignore.build_rules(True, {"/r": ["*.tmp", "build"]})
    ps = ["/r/a.py", "/r/a.pyc", "/r/.git/x", "/r/x.tmp", "/r/build/y", "/r/builds", "/q/x.tmp", "/r/n/__pycache__/k", "/r/.DS_Store"]
    df = spark.createDataFrame([(p,) for p in ps], "abs_path string")
    assert sorted(r[0] for r in ignore.apply_rules(df, rules).collect()) == ["/q/x.tmp", "/r/a.py", "/r/builds"]
    assert ignore.apply_rules(df, None).count() == len(ps)
    table = ignore.rules_table(spark, rules)
    assert sorted(r[0] for r in ignore.apply_path_rules(df, table).collect()) == sorted(p for p in ps if p != "/r/build/y")


def test_requests_ask_twice_for_deleted_and_directories(spark):
    rows = [("modified", "/r", "a", False), ("deleted", "/r", "b", False), ("added", "/r", "c", True), ("added", None, "z", False), ("added", "/n", "y", False), ("deleted", "/r", "d\\e", False)]
    ok = spark.createDataFrame([("/r", True), ("/n", False)], "repo_root string, root_ok boolean")
    got = ignore.requests(events(spark, rows), ok, 2)
    assert sorted(r["asked"] for r in got.collect()) == ["a", "b", "b/", "c", "c/", "d/e", "d/e/"]
    assert sorted(r["n"] for r in got.groupBy("chunk").agg(F.count("*").alias("n")).collect()) == [1, 2, 2, 2]


def test_fail_open_is_per_root(spark):
    ignored = spark.createDataFrame([("/r", "a"), ("/s", "b")], "repo_root string, rel_key string")
    failed = spark.createDataFrame([("/s", "boom"), ("/s", "again")], "repo_root string, error string")
    left, warnings = ignore.fail_open(ignored, failed)
    assert [tuple(r) for r in left.collect()] == [("/r", "a")]
    assert [r["warning"] for r in warnings.collect()] == ["gitignore filtering failed for /s: again (fail-open)"]


def test_null_roots_are_never_dropped(spark):
    ev = events(spark, [("added", None, "a", False), ("added", "/r", "a", False), ("added", "/r", "b/", False)])
    ignored = spark.createDataFrame([("/r", "a"), ("/r", "b")], "repo_root string, rel_key string")
    assert kept(ignore.drop_ignored(ev, ignored)) == ["a"]


def test_real_git(spark, tmp_path):
    repo, plain = tmp_path / "repo", tmp_path / "plain"
    repo.mkdir(), plain.mkdir()
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    (repo / ".gitignore").write_text("*.log\nout/\n")
    ev = events(spark, [("added", str(repo), "a.log", False), ("added", str(repo), "a.py", False), ("deleted", str(repo), "out", False), ("added", str(plain), "b.log", False), ("added", None, "c.log", False)])
    out, warnings = ignore.git_filter(ev, [str(repo), str(plain)], chunk=1)
    assert kept(out) == ["a.py", "b.log", "c.log"] and warnings.count() == 0
    assert kept(ignore.git_filter(ev, [str(repo)], enabled=False)[0]) == ["a.log", "a.py", "b.log", "c.log", "out"]
    assert ignore.git_check_ignore(str(repo), []) == set()
    assert ignore.gitignore_status([str(repo), str(plain)], True)[2] == {str(repo): True, str(plain): False}


def test_broken_root_warns_and_keeps(spark, tmp_path):
    ev = events(spark, [("added", str(tmp_path), "a.log", False)])
    ok = spark.createDataFrame([(str(tmp_path), True)], "repo_root string, root_ok boolean")
    found, failed = ignore.ignored_by_git(ignore.requests(ev, ok, 10))
    ignored, warnings = ignore.fail_open(found, failed)
    assert kept(ignore.drop_ignored(ev, ignored)) == ["a.log"] and warnings.count() == 1


def test_native_rules_equal_git(spark, tmp_path):
    """Ignore files with order, negation, anchors and folders, each path as git itself answers for it."""
    lines = "# no\n*.log\n!keep.log\n/top.txt\nbuild/\n!build/a.py\ndoc/*.md\n!doc/b.md\n**/deep/x\nlib/**\n!lib/k\na/**/z\n\\!odd\n\\#odd\nsp ace\ntrail   \n[ab]?.c\n[!x]9\nq\\*r\n"
    inner = "*.py\n!/b.py\n"
    repo = tmp_path / "repo"
    (repo / "sub").mkdir(parents=True)
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    (repo / ".gitignore").write_text(lines)
    (repo / "sub" / ".gitignore").write_text(inner)
    names = ["x.log", "keep.log", "d/keep.log", "d/x.log", "top.txt", "d/top.txt", "build", "build/", "build/a.py", "d/build/c", "doc/a.md", "doc/b.md", "d/doc/a.md", "deep/x", "d/e/deep/x", "deep/x/y", "lib", "lib/k", "lib/m/n", "a/z", "a/b/z", "a/b/c/z/t", "!odd", "#odd", "sp ace", "trail", "a1.c", "b/a1.c", "c1.c", "x9", "y9", "q*r", "qxr", "sub/a.py", "sub/b.py", "sub/d/b.py", "ok.txt"]
    forced = ["tracked.log", "build2/t.log"]
    for f in forced:
        (repo / f).parent.mkdir(exist_ok=True)
        (repo / f).write_text("x")
        subprocess.run(["git", "-C", str(repo), "add", "-f", f], check=True)
    names += forced
    root = str(repo)
    asked = spark.createDataFrame([(root, n.rstrip("/"), n, 0) for n in names], "repo_root string, rel_key string, asked string, chunk int")
    rules = ignore.git_rules(root, lines)
    rules = spark.createDataFrame(rules + ignore.git_rules(root, inner, "sub", len(rules)), ignore.GIT_RULE)
    tracked = spark.createDataFrame([(root, f) for f in forced], "repo_root string, rel_key string")
    got = {r["rel_key"] for r in ignore.ignored_by_rules(asked, rules, tracked).collect()}
    assert got == ignore.git_check_ignore(root, names)
