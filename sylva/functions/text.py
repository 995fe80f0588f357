"""Globs, regular expressions and message templates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """Anchored; stars cross slashes, as no separators are set."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            inside = glob[i + 1 : j]
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]"
            i = j
        elif c == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out += "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : j].split(",")) + ")"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def path_kept(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Paths that an include glob matches, if there are any, and no exclude glob does."""
    kept = F.lit(True)
    if include:
        kept = path.rlike("|".join(map(glob_regex, include)))
    return kept & ~path.rlike("|".join(map(glob_regex, exclude))) if exclude else kept


def java_regex(pattern: str) -> str:
    """A named group's Python-style spelling becomes Java's."""
    return pattern.replace("(?P<", "(?<")


def fill_message(template: Column, captures: Column) -> Column:
    """@name replaced by each capture's text, in their order; @a also in what @ab would be."""
    return F.aggregate(captures, template, lambda m, c: F.replace(m, F.concat(F.lit("@"), c["name"]), F.coalesce(c["text"], F.lit(""))))
