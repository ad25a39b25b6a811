"""Scalar helpers on columns: paths, specifiers, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: * and ? stay in a segment, ** crosses segments, {a,b} is either, [ab] one sign."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] in "/{,"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        end = glob.find("]", i + 2)
        if c == "[" and end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
            continue
        if c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c)
        i += 1
    return f"^{out}$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether the last glob that matches a path, in order, is not one with a leading '!'."""
    hits = [F.when(path.rlike(glob_pattern(g.removeprefix("!"))), F.lit(not g.startswith("!"))) for g in reversed(globs)]
    return F.coalesce(*hits, F.lit(False))


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1)


def links(markup: Column) -> Column:
    """Targets of href attributes, in order."""
    return F.regexp_extract_all(markup, F.lit('href="([^"]*)"'), 1)
