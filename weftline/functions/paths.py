"""Expressions on path strings. Containment is by components: /a/bc is not under /a/b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The last component, or the path itself where that is empty (as for /)."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), path)


def is_under(path: Column, root: Column) -> Column:
    """Whether the path is the root or lies below it."""
    return (path == root) | F.startswith(path, F.when(root == "/", root).otherwise(F.concat(root, F.lit("/"))))


def relative(path: Column, root: Column) -> Column:
    """The path below the root, "." for the root itself; the path as it is without a root."""
    below = F.substr(path, F.when(root == "/", F.lit(2)).otherwise(F.length(root) + 2))
    return F.when(root.isNull(), path).when(path == root, ".").otherwise(below)


def depth(path: Column) -> Column:
    """How many components a path has, the root directory counting as one."""
    return F.when(path == "/", 1).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """The path and all directories above it up to /, as an array."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(path == "/", F.array(F.lit("/"))).when(F.size(parts) < 2, F.array(path)).otherwise(F.array_union(F.array(F.lit("/")), above))


def slashes(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def compare_key(path: Column) -> Column:
    """What ignored paths are compared by: slashes, and none at the end."""
    return F.rtrim(slashes(path), F.lit("/"))


def to_uri(path: Column) -> Column:
    """The file: URI of an absolute path, percent-encoded but for unreserved characters and slashes."""
    out = F.url_encode(path)
    for coded, plain in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.concat(F.lit("file://"), out)


def glob_to_regex(pattern: str) -> str:
    """A regular expression for a glob in which * and ? cross slashes; [..] sets and [!..] are kept. Anchors are not included."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            start = i + (pattern[i : i + 1] == "!")
            end = pattern.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
            else:
                inner = pattern[start:end].replace("\\", "\\\\").replace("[", r"\[").replace("&&", r"&\&").replace("^", r"\^")
                out.append(f"[{'^' if start > i else ''}{inner}]")
                i = end + 1
        else:
            out.append(escape_regex(c))
    return "".join(out)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def named_parts(path: Column) -> Column:
    """Its parts that are not empty."""
    return F.filter(parts(path), lambda x: x != "")


def joined(path: Column, by: str) -> Column:
    """Its parts with another separator."""
    return F.array_join(parts(path), by)


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def resolved(path: Column, below: str = "/") -> Column:
    """An absolute path as it is, any other below a folder."""
    return F.when(is_absolute(path), path).otherwise(F.concat(F.lit(below.rstrip("/") + "/"), path))


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(path, s))


def without_suffix(path: Column, suffix: str, instead: str = "") -> Column:
    return F.regexp_replace(path, escape_regex(suffix) + "$", instead)


def matches_glob(path: Column, glob: str) -> Column:
    """Whether the whole path matches a glob whose * and ? cross slashes."""
    return path.rlike("(?s)^" + glob_to_regex(glob) + r"\z")


def git_glob_to_regex(pattern: str) -> str:
    """A regular expression for a glob of an ignore file: * and ? stay within a folder, ** between slashes spans folders, a
    backslash takes a character as it is. Anchors are not included."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out.append(".+")
            i = n
        elif c == "*":
            while pattern[i : i + 1] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in "!^"))) > 0:
            other = pattern[i + 1] in "!^"
            inner = pattern[i + 1 + other : end].replace("\\", "\\\\").replace("[", r"\[").replace("]", r"\]").replace("&&", r"&\&").replace("^", r"\^")
            out.append(f"(?!/)[{'^' if other else ''}{inner}]")
            i = end + 1
        elif c == "\\" and i + 1 < n:
            out.append(escape_regex(pattern[i + 1]))
            i += 2
        else:
            out.append(escape_regex(c))
            i += 1
    return "".join(out)


def escape_regex(text: str) -> str:
    """The text as a regular expression that matches it, in Java's and RE2's dialect."""
    return "".join("\\" + c if c in r"\.^$|()[]{}*+?-#&~" else c for c in text)
