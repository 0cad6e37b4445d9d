"""The rule index and nested ignore files against git, and against the plan that meets every rule."""

import random
import subprocess

import pytest

from weftline.operators import ignore, ignoreindex
from weftline.sources import ignorefiles

ASKED = "repo_root string, rel_key string, asked string"


def asked(spark, root, names):
    return spark.createDataFrame([(root, n.rstrip("/"), n) for n in names], ASKED)


def answer(df):
    return {r["rel_key"] for r in df.collect()}


@pytest.mark.parametrize(
    "body, want",
    [
        ("name", ("name", "name")), ("/a/name", ("name", "name")), ("*.py", ("tail", ".py")), ("f*", ("head", "f")), ("ab*c", ("head", "ab")), ("a*bcd", ("tail", "bcd")),
        ("lib/**", ("top", "lib")), ("**", ("any", "")), ("?", ("any", "")), ("[ab]?.c", ("tail", ".c")), (r"\#odd", ("tail", "odd")), (r"a\*b", ("head", "a")), ("**/deep/x", ("name", "x")), ("*/x/?", ("any", "")),
    ],
)
def test_literals(body, want):
    assert ignoreindex.literal_of(body) == want


TREE = {
    "": "# no\n*.log\n!keep.log\n/top.txt\nbuild/\n!build/a.py\ndoc/*.md\n!doc/b.md\n**/deep/x\nlib/**\n!lib/k\na/**/z\n\\!odd\n\\#odd\nsp ace\ntrail   \n[ab]?.c\n[!x]9\nq\\*r\n",
    "sub": "*.py\n!/b.py\n/only\n!*.log\n",
    "sub/in": "!*.py\n*\n!keep*\n!dir/\n",
    "sub/in/dir": "x\n!y\n",
    "build": "!*\n",
    "other": "**\n!*.txt\n!/d/\n",
}
NAMES = [
    "x.log", "keep.log", "d/keep.log", "d/x.log", "top.txt", "d/top.txt", "build", "build/", "build/a.py", "d/build/c", "doc/a.md", "doc/b.md", "d/doc/a.md", "deep/x", "d/e/deep/x", "deep/x/y",
    "lib", "lib/k", "lib/m/n", "a/z", "a/b/z", "a/b/c/z/t", "!odd", "#odd", "sp ace", "trail", "a1.c", "b/a1.c", "c1.c", "x9", "y9", "q*r", "qxr", "sub/a.py", "sub/b.py", "sub/d/b.py", "ok.txt", "sub/only", "sub/d/only",
    "only", "sub/x.log", "sub/in/a.py", "sub/in/z", "sub/in/keepme", "sub/in/x.log", "sub/in/dir/x", "sub/in/dir/y", "sub/in/dir/z", "other/a", "other/a.txt", "other/d/a.txt", "other/d/a", "excluded.md", "sub/excluded.md", "back.md",
]


def made_tree(path):
    repo = path / "repo"
    repo.mkdir()
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    for folder, text in TREE.items():
        (repo / folder).mkdir(parents=True, exist_ok=True)
        (repo / folder / ".gitignore").write_text(text)
    (repo / ".git/info/exclude").write_text("*.md\n!back.md\n*.txt\n")
    return repo


def test_nested_files_equal_git(spark, tmp_path):
    root = str(made_tree(tmp_path))
    rows = asked(spark, root, NAMES)
    found = ignorefiles.files_of(spark, root)
    assert {r["folder"] for r in found.collect()} == set(TREE) and found.where("excludes").count() == 1
    # git reads no file below an ignored folder, which changes no answer
    assert answer(ignorefiles.ignored(rows, found)) == ignore.git_check_ignore(root, NAMES)
    shuffled = spark.createDataFrame(sorted(found.collect(), key=lambda r: r["text"]), found.schema)
    assert answer(ignorefiles.ignored(rows, shuffled)) == ignore.git_check_ignore(root, NAMES)


def test_tracked_paths_and_other_roots_stay(spark, tmp_path):
    root = str(made_tree(tmp_path))
    rows = asked(spark, root, ["x.log", "d/x.log"]).union(asked(spark, "/elsewhere", ["x.log"]))
    tracked = spark.createDataFrame([(root, "d/x.log")], "repo_root string, rel_key string")
    got = ignorefiles.ignored(rows, ignorefiles.files_of(spark, root), tracked)
    assert [tuple(r) for r in got.collect()] == [(root, "x.log")]
    assert ignoreindex.ignored(rows, spark.createDataFrame([], ignoreindex.RULE)).count() == 0


def test_filter_without_git(spark, tmp_path, monkeypatch):
    root = str(made_tree(tmp_path))
    names = [("added", n) for n in ("x.log", "keep.log", "sub/a.py", "sub/b.py", "ok.py")] + [("deleted", "build")]
    ev = spark.createDataFrame([(k, c, f"{root}/{n}", root, n, False) for k, (c, n) in enumerate(names)] + [(99, "added", "z.log", None, "z.log", False)], "seq long, change string, abs_path string, repo_root string, rel_path string, is_dir boolean")
    with_git = answer(ignore.git_filter(ev, [root])[0].withColumnRenamed("rel_path", "rel_key"))
    monkeypatch.setattr(ignore, "git_available", lambda: False)
    rules = ignorefiles.rules_of(ignorefiles.files_of(spark, root))
    assert answer(ignore.git_filter(ev, [root], rules=rules)[0].withColumnRenamed("rel_path", "rel_key")) == with_git == {"keep.log", "sub/b.py", "ok.py", "z.log"}
    assert ignore.git_filter(ev, [root])[0].count() == len(names) + 1
    assert ignore.git_filter(ev, [root], enabled=False, rules=rules)[0].count() == len(names) + 1


def test_many_rules_meet_few_paths(spark):
    rng = random.Random(2)
    lines = []
    for k in range(10_000):
        lines.append(rng.choice(["", "", "", "!"]) + rng.choice([f"file{k}.py", f"*{k}.md", f"mod{k}*", f"/d{k % 50}/f{k}.ts", f"d{k}/", f"*_{k}_*", f"d{k % 50}/**/g{k}"]))
    names = {rng.choice([f"file{k}.py", f"a/{k}.md", f"d{k % 50}/f{k}.ts", f"d{k}/x", f"mod{k}z", f"q_{k}_w", f"d{k % 50}/b/c/g{k}", f"none{k}"]) for k in rng.sample(range(10_000), 400)}
    rows = asked(spark, "/r", sorted(names)).union(asked(spark, "/s", sorted(names)))
    files = spark.createDataFrame([("/r", "", "\n".join(lines), False)], ignorefiles.FILE)
    rules = ignorefiles.rules_of(files).persist()
    assert rules.count() == 10_000
    plain = ignore.ignored_by_rules(rows, rules.withColumn("ord", (rules["ord"] - (1 << 40)).cast("int")).select("repo_root", "ord", "pattern", "negated", "dir_only"))
    got = ignoreindex.ignored(rows, rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() > 50
    # what the join lets through: near the matches, not rules x paths
    plan = ignoreindex.matches(rows, rules)
    matched = plan.count()
    plan.collect()
    node = plan._jdf.queryExecution().executedPlan()
    met = _rows_of_joins(node)
    assert met and max(met) < 40 * matched
    rules.unpersist()


def _rows_of_joins(node):
    """numOutputRows of the joins of an executed plan."""
    out, name = [], node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _rows_of_joins(node.executedPlan())
    if "QueryStage" in name:
        return _rows_of_joins(node.plan())
    if "Join" in name and node.metrics().contains("numOutputRows"):
        out.append(node.metrics().apply("numOutputRows").value())
    children = node.children()
    for k in range(children.size()):
        out += _rows_of_joins(children.apply(k))
    return out
