"""Parts of URLs as Spark columns and as DuckDB expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_REST = r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port, leading www. and last dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"^www\.|\.$", "")


def rest(url: Column) -> Column:
    """Path and query."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _REST, 1)


def sort_key(url: Column) -> Column:
    """Host labels reversed, then path and query: captures of a site lie together."""
    return F.concat(F.array_join(F.reverse(F.split(host(url), r"\.")), ","), F.lit(")"), rest(url))


def parts(url: Column) -> Column:
    """Reversed host labels, a slash, then the path's segments that aren't empty."""
    segments = F.filter(F.split(F.regexp_extract(rest(url), r"^([^?]*)", 1), "/"), lambda x: x != "")
    return F.concat(F.reverse(F.split(host(url), r"\.")), F.array(F.lit("/")), segments)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL_HOST = rf"regexp_replace(lower(regexp_extract(coalesce(url, ''), {_sql(_HOST)}, 1)), '^www\.|\.$', '', 'g')"
SQL_REST = f"regexp_extract(coalesce(url, ''), {_sql(_REST)}, 1)"
SQL_SORT_KEY = f"array_to_string(list_reverse(string_split({SQL_HOST}, '.')), ',') || ')' || {SQL_REST}"
SQL_PARTS = f"list_concat(list_concat(list_reverse(string_split({SQL_HOST}, '.')), ['/']), list_filter(string_split(regexp_extract({SQL_REST}, '^([^?]*)', 1), '/'), lambda x: x <> ''))"
