"""Ignore rules of any number, found by equality joins.

Each rule is filed under a literal that every path it matches must have: the last name, a beginning or an end of it, or the
first folder. A path is asked for under its own name, the beginnings and ends of the lengths that occur, and its first
folder, so it meets the rules that nearly match it and no others; only rules without any literal (``*``, ``?``) meet
every path of their folder. What was met is then matched by the rule's regular expression. Rules belong to the folder of their
ignore file, so one file's rules never meet paths outside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import paths

#: Rows of rules: the folder below the root that the file lies in (empty for the root), the precedence, git_rules' pattern of the path
#: below the root, and the literal that the rule is filed under.
RULE = "repo_root string, folder string, ord long, pattern string, negated boolean, dir_only boolean, kind string, literal string"

NAME, HEAD, TAIL, TOP, ANY = "name", "head", "tail", "top", "any"
_SPECIAL = "*?[]\\"


def literal_of(body: str) -> tuple[str, str]:
    """(kind, literal) that a rule is filed under; body: the rule without ! in front and / at the end."""
    steps = body.removeprefix("/").split("/")
    last = steps[-1]
    at = [k for k, c in enumerate(last) if c in _SPECIAL]
    if not at:
        return (NAME, last) if last else (ANY, "")
    head, tail = last[: at[0]], last[at[-1] + 1 + (last[at[-1]] == "\\") :]
    if head or tail:
        return (HEAD, head) if len(head) >= len(tail) else (TAIL, tail)
    if len(steps) > 1 and steps[0] and not any(c in _SPECIAL for c in steps[0]):
        return TOP, steps[0]
    return ANY, ""


def _above(path: Column) -> Column:
    """The folders that a path lies in, the root (empty) first."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def _keys(name: Column, first: Column, lengths: dict[str, list[int]]) -> Column:
    """What a path may be filed under: (kind, literal)."""
    key = lambda kind, literal: F.struct(F.lit(kind).alias("kind"), literal.alias("literal"))
    found = [key(NAME, name), key(TOP, first), key(ANY, F.lit(""))]
    for kind, cut in ((HEAD, F.left), (TAIL, F.right)):
        found += [key(kind, F.when(F.length(name) >= n, cut(name, F.lit(n)))) for n in lengths.get(kind, [])]
    return F.filter(F.array(*found), lambda k: k["literal"].isNotNull())


def matches(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_root, path, is_dir, ord, negated) of the rules that match asked paths or folders above them; each such path once, however
    many paths lie below. asked: (repo_root, asked), directories with a slash at the end. rules: see RULE."""
    plain = F.rtrim(F.col("asked"), F.lit("/"))
    steps = F.split(plain, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("path"), ((n < F.size(steps)) | F.col("asked").endswith("/")).alias("is_dir")))
    each = asked.select("repo_root", F.explode(every).alias("p")).select("repo_root", "p.path", "p.is_dir").distinct()
    # lengths of beginnings and ends: no more of them than the longest rule has characters
    lengths: dict[str, list[int]] = {}
    for r in rules.where(F.col("kind").isin(HEAD, TAIL)).select("kind", F.length("literal").alias("n")).distinct().collect():
        lengths.setdefault(r["kind"], []).append(r["n"])
    below = each.select("*", F.explode(_above(F.col("path"))).alias("folder")).join(rules.select("repo_root", "folder").distinct(), ["repo_root", "folder"])
    inside = F.split(F.substr("path", F.when(F.col("folder") == "", 1).otherwise(F.length("folder") + 2)), "/")
    filed = below.select("*", F.explode(_keys(F.element_at(inside, -1), F.element_at(inside, 1), {k: sorted(v) for k, v in lengths.items()})).alias("k"))
    met = filed.select("repo_root", "folder", "path", "is_dir", "k.kind", "k.literal").join(rules, ["repo_root", "folder", "kind", "literal"])
    return met.where(F.regexp("path", F.col("pattern")) & (~F.col("dir_only") | F.col("is_dir"))).select("repo_root", "path", "is_dir", "ord", "negated")


def ignored(asked: DataFrame, rules: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """(repo_root, rel_key) of asked rows (repo_root, rel_key, asked) that the rules leave out: of each path and each folder above it the
    matching rule of the highest ord decides, and nothing below an ignored folder can be taken back. tracked: (repo_root,
    rel_key) of paths under version control, which are never ignored.

    A folder that a rule takes back is not ignored. Git, asked for such a folder with a slash at the end, says that it is: it matches
    the empty name after the slash, which any ``*`` takes.
    """
    last = matches(asked, rules).groupBy("repo_root", "path", "is_dir").agg(F.max_by("negated", "ord").alias("negated"))
    out = last.where(~F.col("negated")).select("repo_root", "path", "is_dir")
    plain = F.rtrim(F.col("asked"), F.lit("/"))
    steps = F.split(plain, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("path"), ((n < F.size(steps)) | F.col("asked").endswith("/")).alias("is_dir")))
    rows = asked.select("repo_root", "rel_key", F.explode(every).alias("p")).select("repo_root", "rel_key", "p.path", "p.is_dir")
    hit = rows.join(out, ["repo_root", "path", "is_dir"], "left_semi").select("repo_root", "rel_key").distinct()
    return hit if tracked is None else hit.join(tracked.select("repo_root", "rel_key"), ["repo_root", "rel_key"], "left_anti")


def asked_of(events: DataFrame) -> DataFrame:
    """(repo_root, rel_key, asked) of events with a root: deleted paths and folders are asked for with a slash too (see
    ignore.requests, which also asks for chunks and for roots that git knows)."""
    plain = paths.slashes(F.col("rel_path"))
    twice = ((F.col("change") == "deleted") | F.col("is_dir")) & ~plain.endswith("/")
    forms = F.when(twice, F.array(plain, F.concat(plain, F.lit("/")))).otherwise(F.array(plain))
    return events.where("repo_root is not null").select("repo_root", paths.compare_key(F.col("rel_path")).alias("rel_key"), F.explode(forms).alias("asked")).distinct()
