"""Repository paths and globs, as plain functions and as columns."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that have a parser.
EXTENSIONS = (".lua", ".js", ".jsx", ".ts", ".tsx")


def normalize(value: str) -> str:
    """A repository-relative path with forward slashes, without empty or `.` segments."""
    if not value:
        raise ValueError("the path is empty")
    posix = value.replace("\\", "/")
    if posix.startswith("/") or re.match(r"[A-Za-z]:/", posix):
        raise ValueError(f"the path must be relative to the repository: {value}")
    segments = [s for s in posix.split("/") if s not in ("", ".")]
    if ".." in segments:
        raise ValueError(f"the path must not contain ..: {value}")
    if not segments:
        raise ValueError("the path names the root")
    return "/".join(segments)


def normalize_column(path: Column) -> Column:
    """normalize() as a column; a path that normalize() refuses raises."""
    segments = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    bad = path.rlike(r"^([/\\]|[A-Za-z]:[/\\])") | F.array_contains(segments, "..") | (F.size(segments) == 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("not a repository path: "), path)).cast("string")).otherwise(F.array_join(segments, "/"))


def resolve_safe(root: str, relative: str) -> str:
    """The real place of a repository path; refuses links that lead out of root."""
    real_root = os.path.realpath(root)
    found = os.path.realpath(os.path.join(real_root, normalize(relative)))
    if found != real_root and not found.startswith(real_root + os.sep):
        raise ValueError(f"the path leaves the repository: {relative}")
    return found


def _glob_regex(pattern: str) -> str:
    """Segment by segment: ** is any number of segments, * anything in one, all else literal."""
    if pattern == "**":
        return "^.*$"
    parts = pattern.split("/")
    out = ""
    for i, part in enumerate(parts):
        if part == "**":
            out += "(?:[^/]+/)*"
        else:
            out += "".join("[^/]*" if c == "*" else re.escape(c) for c in part)
            out += "/" if i + 1 < len(parts) else ""
    return f"^{out}$"


def glob_predicate(pattern: str) -> tuple[str, str]:
    """A glob as one of three tests: (segment, name), (under, base) or (regex, expression).

    `name/` is any segment of that name; `a/b/` and `a/**` are the base, taken literally,
    and all below.
    """
    p = re.sub("/+", "/", pattern.replace("\\", "/"))
    p = p[2:] if p.startswith("./") else p
    if p.endswith("/"):
        return ("under", p[:-1]) if "/" in p[:-1] else ("segment", p[:-1])
    if p.endswith("/**"):
        return "under", p[:-3]
    return "regex", _glob_regex(p)


def glob_matches(patterns: Sequence[str], path: str) -> bool:
    for kind, x in map(glob_predicate, patterns):
        if kind == "segment" and x in path.split("/") or kind == "under" and (path == x or path.startswith(x + "/")) or kind == "regex" and re.match(x, path, re.S):
            return True
    return False


def glob_column(path: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern matches: a disjunction that Catalyst evaluates, no Python."""
    out = F.lit(False)
    for kind, x in map(glob_predicate, patterns):
        if kind == "segment":
            out = out | F.array_contains(F.split(path, "/"), x)
        elif kind == "under":
            out = out | (path == x) | path.startswith(x + "/")
        else:
            out = out | path.rlike("(?s)" + x)
    return out


def ancestors_column(path: Column) -> Column:
    """Every directory above a path and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def excluded_column(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path, or a directory above it, matches: what lies below goes with it."""
    if not patterns:
        return F.lit(False)
    return F.exists(ancestors_column(path), lambda p: glob_column(p, patterns))


def supported_column(path: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    """Whether a path has one of the extensions and declares more than types."""
    return reduce(Column.__or__, [path.endswith(e) for e in extensions]) & ~path.endswith(".d.ts")


def is_supported(path: str, extensions: Sequence[str] = EXTENSIONS) -> bool:
    """supported_column() of one path."""
    return path.endswith(tuple(extensions)) and not path.endswith(".d.ts")


def looks_like_path(text: str) -> bool:
    return text.endswith(EXTENSIONS) or "/" in text or "\\" in text


def fragment_of(text: str, root: str | None = None, star: bool = False) -> str:
    """A user's path or part of one, ready for fragment_column()."""
    p = text.strip().replace("\\", "/")
    if star and p == "*":
        return "*"
    if root is not None:
        if os.path.isabs(p):
            p = posixpath.relpath(os.path.realpath(p), os.path.realpath(root))
        return normalize(p).lower()
    return (p[2:] if p.startswith("./") else p).lower()


def fragment_column(path: Column, fragment: str) -> Column:
    """Part of a path, or an absolute path that ends with it; case doesn't count."""
    if fragment == "*":
        return F.lit(True)
    low = F.lower(path)
    return low.contains(fragment) | F.lit(fragment).endswith(F.concat(F.lit("/"), low))


def fragment_matches(path: str, fragment: str) -> bool:
    return fragment == "*" or fragment in path.lower() or fragment.endswith("/" + path.lower())


def basename_column(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname_column(path: Column) -> Column:
    """The directory of a path; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def fold_column(path: Column) -> Column:
    """POSIX normalisation: `.` and empty segments go, `..` takes the one before with it.

    Leading `..` that have nothing to take stay, as in path.normalize.
    """
    start = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, F.when(F.size(acc) > 0, F.lit(-1)).otherwise(F.lit(None).cast("int"))), F.lit("")) != "..")
        return F.when(s.isin("", "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
