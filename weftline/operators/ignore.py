"""Ignore rules as rows, and filters that drop what they match.

A rule row is (root, seq, kind, value): kinds are dir (a component's name), name (a regular expression searched in the base
name), glob (a regular expression for the whole path) and path (a path and all below it).
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import paths
from weftline.model import WatchConfig
from weftline.operators import ignoreindex

#: What file watchers ignore by default, as names of directories and patterns of base names.
DEFAULT_DIRS = ("__pycache__", ".git", ".hg", ".svn", ".tox", ".venv", ".idea", "node_modules", ".mypy_cache", ".pytest_cache", ".hypothesis")
DEFAULT_NAMES = (r"\.py[cod]$", r"\.___jb_...___$", r"\.sw.$", "~$", r"^\.\#", r"^\.DS_Store$", r"^flycheck_")

RULE = "root string, seq int, kind string, value string"


def is_glob(raw: str) -> bool:
    """Only * and ? make a rule a glob; a lone [ does not."""
    return "*" in raw or "?" in raw


def unique(values: Sequence[str]) -> list[str]:
    """First occurrences, in order."""
    return list(dict.fromkeys(values))


def build_rules(use_defaults: bool, custom: Mapping[str, Sequence[str]], dirs: Sequence[str] = (), globs: Sequence[str] = (), names: Sequence[str] = ()) -> list[tuple[str | None, int, str, str]] | None:
    """Rule rows for the defaults and each root's own ignores, and for every root directory names, globs and regular
    expressions of base names; None if nothing is to be filtered.

    Globs are bound to their root and match the whole path below it; other values are paths, below the root unless
    absolute. Equal rules of a kind stand once.
    """
    if not (use_defaults or custom or dirs or globs or names):
        return None
    found: list[tuple[str | None, str, str]] = []
    if use_defaults:
        found += [(None, "dir", d) for d in DEFAULT_DIRS] + [(None, "name", n) for n in DEFAULT_NAMES]
    found += [(None, "dir", d) for d in dirs] + [(None, "name", "^" + paths.glob_to_regex(g) + r"\z") for g in globs] + [(None, "name", n) for n in names]
    for root, ignores in custom.items():
        for raw in ignores:
            if is_glob(raw):
                found.append((root, "glob", "^" + paths.escape_regex(root.rstrip("/") + "/") + paths.glob_to_regex(raw) + r"\z"))
            else:
                found.append((root, "path", raw.rstrip("/") if raw.startswith("/") else f"{root.rstrip('/')}/{raw.rstrip('/')}"))
    seen, out = set(), []
    for root, kind, value in found:
        if (kind, value) not in seen:
            seen.add((kind, value))
            out.append((root, len(out), kind, value))
    return out


def rules_of(cfg: WatchConfig) -> list[tuple] | None:
    return build_rules(cfg.defaults_filter, cfg.repo_custom_ignores, cfg.ignore_dirs, cfg.ignore_globs, cfg.ignore_names)


def rules_table(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE)


def unique_rules(rules: DataFrame) -> DataFrame:
    """Rule rows of which the first of equal (kind, value) stays."""
    w = Window.partitionBy("kind", "value").orderBy("seq")
    return rules.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def merged_rules(*tables: DataFrame) -> DataFrame:
    """Rule rows of all tables, equal (kind, value) once: the first by seq."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return unique_rules(out)


def union_of_chunks(*found: DataFrame) -> DataFrame:
    """(repo_root, rel_path) that any chunk's answer holds, once."""
    out = found[0].select("repo_root", "rel_path")
    for f in found[1:]:
        out = out.union(f.select("repo_root", "rel_path"))
    return out.distinct()


def matches(path: Column, rules: Sequence[tuple] | None) -> Column:
    """Whether any rule of a driver-side list matches the path: one expression, so that the filter stays in the scan's stage."""
    out = F.lit(False)
    parts = F.split(path, "/")
    by: dict[str, list[str]] = {}
    for _, _, kind, value in rules or ():
        by.setdefault(kind, []).append(value)
    if "dir" in by:
        out = out | F.arrays_overlap(parts, F.array(*map(F.lit, by["dir"])))
    for value in by.get("name", ()):
        out = out | F.element_at(parts, -1).rlike(value)
    for value in by.get("glob", ()):
        out = out | path.rlike("(?s)" + value)
    for value in by.get("path", ()):
        out = out | paths.is_under(path, F.lit(value))
    return out


def apply_rules(events: DataFrame, rules: Sequence[tuple] | None, path: str = "abs_path") -> DataFrame:
    """events without those that a rule matches; all of them for None."""
    return events if rules is None else events.where(~matches(F.col(path), rules))


def apply_path_rules(events: DataFrame, rules: DataFrame, path: str = "abs_path") -> DataFrame:
    """events without those at or below a path rule of a table of any size: an anti join on the path's ancestors."""
    below = events.select(F.col(path).alias("p_")).distinct().select("p_", F.explode(paths.ancestors(F.col("p_"))).alias("value"))
    hit = below.join(rules.where("kind = 'path'").select("value"), "value", "left_semi").select("p_").distinct()
    return events.join(hit, events[path] == hit["p_"], "left_anti")


def git_available() -> bool:
    return shutil.which("git") is not None


def git_is_worktree(root: str, timeout_s: float = 10.0) -> bool:
    if not git_available() or not os.path.isdir(root):  # git is not asked of what is not there
        return False
    done = subprocess.run(["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True, text=True, timeout=timeout_s)
    return done.returncode == 0 and done.stdout.strip() == "true"


def gitignore_status(roots: Sequence[str], enabled: bool) -> tuple[bool, bool, dict[str, bool]]:
    """(enabled, git is there, root -> is a worktree); nothing is probed where it cannot matter."""
    there = enabled and git_available()
    return enabled, there, {r: there and git_is_worktree(r) for r in roots}


def statuses(roots: DataFrame, enabled: bool) -> DataFrame:
    """(root, root_ok) of distinct roots (root), asked in the tasks, which see the roots."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(list(gitignore_status(frame["root"].tolist(), enabled)[2].items()), columns=["root", "root_ok"])

    return roots.select("root").where("root is not null").distinct().mapInPandas(ask, "root string, root_ok boolean")


def git_check_ignore(root: str, rel_paths: Sequence[str], timeout_s: float = 10.0) -> set[str]:
    """Those of the paths that git ignores, without trailing slashes; RuntimeError if git fails."""
    if not rel_paths:
        return set()
    done = subprocess.run(["git", "-C", root, "check-ignore", "-z", "--stdin"], input="\0".join(rel_paths) + "\0", capture_output=True, text=True, timeout=timeout_s)
    if done.returncode not in (0, 1):
        raise RuntimeError(done.stderr.strip() or f"git check-ignore ended with {done.returncode}")
    return {p.rstrip("/") for p in done.stdout.split("\0") if p}


def requests(events: DataFrame, root_ok: DataFrame, chunk: int) -> DataFrame:
    """(repo_root, rel_key, asked, chunk): what is asked for each root, deleted paths and directories also with a slash at the end.
    A root and chunk have at most ``chunk`` rows; its number tells chunks apart and means no more.

    root_ok: (repo_root, root_ok). Events without a root or below one that is no worktree are not asked for.
    """
    asked = events.where("repo_root is not null").join(root_ok.where("root_ok").select("repo_root"), "repo_root", "left_semi")
    plain = paths.slashes(F.col("rel_path"))
    twice = (F.col("change") == "deleted") | F.col("is_dir")
    forms = F.when(twice & ~plain.endswith("/"), F.array(plain, F.concat(plain, F.lit("/")))).otherwise(F.array(plain))
    rows = asked.select("repo_root", paths.compare_key(F.col("rel_path")).alias("rel_key"), F.explode(forms).alias("asked"), "seq")
    # consecutive rows of a partition, so at most ``chunk`` of a root: no root is sorted or gathered to be numbered
    return rows.withColumn("chunk", F.floor(F.monotonically_increasing_id() / chunk)).drop("seq")


GIT_RULE = "repo_root string, ord int, pattern string, negated boolean, dir_only boolean"


def rule_lines(text: str) -> Iterator[tuple[bool, str, bool]]:
    """(negated, glob, dir_only) of the lines of an ignore file that are rules."""
    for line in text.splitlines():
        kept = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not kept or kept.startswith("#"):
            continue
        negated = kept.startswith("!")
        body = kept[1:] if negated else kept
        if plain := body.rstrip("/"):
            yield negated, plain, body.endswith("/")


def git_rules(root: str, text: str, folder: str = "", first: int = 0) -> list[tuple[str, int, str, bool, bool]]:
    """GIT_RULE rows of an ignore file's lines, in order from ``first`` on. folder: where below the root the file lies; the files of
    deeper folders must come later. pattern is a regular expression for a path below the root."""
    prefix = paths.escape_regex(folder.strip("/") + "/") if folder.strip("/") else ""
    out = []
    for negated, body, dir_only in rule_lines(text):
        anywhere = "" if "/" in body else "(?:.*/)?"
        out.append((root, first + len(out), "(?s)^" + prefix + anywhere + paths.git_glob_to_regex(body.removeprefix("/")) + r"\z", negated, dir_only))
    return out


def ignored_by_rules(asked: DataFrame, rules: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """(repo_root, rel_key) of asked rows (see requests) that ignore files leave out, without git being asked.

    rules: GIT_RULE rows. For a path and each folder above it the last rule that matches decides, and a path is ignored if
    any of these is: nothing below an ignored folder can be taken back. tracked: (repo_root, rel_key) of paths under version
    control, which are never ignored. Rules are configuration, so they are broadcast; the work is one row for each path, folder
    above it and rule, aggregated before anything is shuffled.
    """
    parts = F.split(F.rtrim(F.col("asked"), F.lit("/")), "/")
    one = asked.select("repo_root", "rel_key", "asked").distinct().withColumn("parts", parts)
    above = one.select("repo_root", "rel_key", "asked", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"), "parts")
    prefix = above.select("repo_root", "rel_key", "asked", "n", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("path"), ((F.col("n") < F.size("parts")) | F.col("asked").endswith("/")).alias("is_dir"))
    hit = prefix.join(F.broadcast(rules), "repo_root").where(F.regexp("path", F.col("pattern")) & (~F.col("dir_only") | F.col("is_dir")))
    last = hit.groupBy("repo_root", "rel_key", "asked", "n").agg(F.max_by("negated", "ord").alias("negated"))
    out = last.where(~F.col("negated")).select("repo_root", "rel_key").distinct()
    return out if tracked is None else out.join(tracked.select("repo_root", "rel_key"), ["repo_root", "rel_key"], "left_anti")


def fail_open(ignored: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ignored keys of roots without a failed chunk, and one warning row for each root with one. failures: (repo_root, error)."""
    warned = failures.groupBy("repo_root").agg(F.min("error").alias("error"))
    text = F.concat(F.lit("gitignore filtering failed for "), F.col("repo_root"), F.lit(": "), F.col("error"), F.lit(" (fail-open)"))
    return ignored.join(warned, "repo_root", "left_anti"), warned.select("repo_root", text.alias("warning"))


def drop_ignored(events: DataFrame, ignored: DataFrame) -> DataFrame:
    """events whose (root, key) is not ignored; a null root never is."""
    keyed = events.withColumn("rel_key", paths.compare_key(F.col("rel_path")))
    return keyed.join(ignored.select("repo_root", "rel_key"), ["repo_root", "rel_key"], "left_anti").select(*events.columns)


def ignored_by_git(asked: DataFrame, timeout_s: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Parity mode: asks git itself, one call for each root and chunk, on executors that see the roots.

    Returns (repo_root, rel_key) of ignored paths and (repo_root, error) of failed chunks.
    """

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        root = key[0]
        try:
            found = git_check_ignore(root, rows["asked"].tolist(), timeout_s)
        except (subprocess.TimeoutExpired, RuntimeError) as e:
            return pd.DataFrame({"repo_root": [root], "rel_key": [None], "error": [str(e)]}, dtype=object)
        keys = sorted({k for k in rows["rel_key"] if k in found})
        return pd.DataFrame({"repo_root": [root] * len(keys), "rel_key": keys, "error": [None] * len(keys)}, dtype=object)

    out = asked.groupBy("repo_root", "chunk").applyInPandas(ask, "repo_root string, rel_key string, error string")
    return out.where("error is null").select("repo_root", "rel_key").distinct(), out.where("error is not null").select("repo_root", "error")


def git_filter(
    events: DataFrame,
    roots: Iterator[str] | Sequence[str],
    enabled: bool = True,
    chunk: int = 4000,
    timeout_s: float = 10.0,
    rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """events (with is_dir and seq) that git does not ignore, and warnings (repo_root, warning).

    rules: rows of ignore files (sources.ignorefiles.rules_of), by which events are filtered where git is not installed; without
    them nothing is filtered there.
    """
    spark = events.sparkSession
    on, there, ok = gitignore_status(list(roots), enabled)
    none = spark.createDataFrame([], "repo_root string, warning string")
    if on and not there and rules is not None:
        return drop_ignored(events, ignoreindex.ignored(ignoreindex.asked_of(events), rules)), none
    if not on or not there:
        return events, none
    root_ok = spark.createDataFrame(list(ok.items()), "repo_root string, root_ok boolean")
    found, failed = ignored_by_git(requests(events, root_ok, chunk), timeout_s)
    ignored, warnings = fail_open(found, failed)
    return drop_ignored(events, ignored), warnings
