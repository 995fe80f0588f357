"""Relational operators over nodes and issues: ancestor joins, suppression, lookups, reports and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIP = r"(?i)\bskipcq\b(?::\s*([A-Za-z\-_0-9]+(?:\s*,\s*[A-Za-z\-_0-9]+)*))?"


def _above(m: DataFrame, f: DataFrame) -> Column:
    return (m["file_id"] == f["file_id"]) & (f["pre"] < m["pre"]) & (m["pre"] <= f["subtree_end"])


def inside(matches: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Matches below one of the ancestors: an interval semi-join within a file."""
    return matches.join(ancestors, _above(matches, ancestors), "left_semi")


def not_inside(matches: DataFrame, ancestors: DataFrame) -> DataFrame:
    return matches.join(ancestors, _above(matches, ancestors), "left_anti")


def skip_comments(comments: DataFrame) -> DataFrame:
    """(file_id, line, checker_ids) of comment nodes (file_id, start_row, text); no ids: all checkers."""
    ids = F.filter(F.transform(F.split(F.regexp_extract("text", _SKIP, 1), ","), F.trim), lambda x: x != "")
    return comments.filter(F.col("text").rlike(_SKIP)).select("file_id", F.col("start_row").alias("line"), ids.alias("checker_ids"))


def suppress(issues: DataFrame, skips: DataFrame) -> DataFrame:
    """Issues (file_id, row, id, ...) without those that a comment on their row or the row above names."""
    s = skips.select(F.col("file_id").alias("s_file"), F.explode(F.array("line", F.col("line") + 1)).alias("s_row"), F.explode_outer("checker_ids").alias("s_id"))
    return issues.join(s, (F.col("file_id") == F.col("s_file")) & (F.col("row") == F.col("s_row")) & (F.col("s_id").isNull() | (F.col("s_id") == F.col("id"))), "left_anti")


def describe(issues: DataFrame, checkers: DataFrame) -> DataFrame:
    """Issues with their checker's category and severity, empty where it has none; of checkers of one id the greatest pair counts."""
    c = checkers.groupBy("id").agg(F.max(F.struct("category", "severity")).alias("__c"))
    joined = issues.join(c, "id", "left")
    return joined.withColumns({k: F.coalesce(F.col(f"__c.{k}"), F.lit("")) for k in ("category", "severity")}).drop("__c")


def exit_status(issues: DataFrame, severities: list[str] = ("critical",), categories: list[str] = ("bug-risk",), code: int = 1) -> DataFrame:
    """(exit_code): the code if an issue's severity or category is listed."""
    fails = F.col("severity").isin(*severities) | F.col("category").isin(*categories)
    return issues.agg(F.when(F.coalesce(F.max(fails), F.lit(False)), F.lit(code)).otherwise(F.lit(0)).alias("exit_code"))


def as_text(path: Column, row: Column, col: Column, message: Column) -> Column:
    return F.format_string("%s:%d:%d:%s", path, row + 1, col, message)


def as_json(issue: Column) -> Column:
    return F.to_json(issue)


def as_record(issues: DataFrame) -> Column:
    """The struct that an issue is in JSON: rows from 1, columns from 0."""
    at = lambda row, col: F.struct((F.col(row) + 1).alias("row"), F.col(col).alias("column"))
    span = F.struct(F.col("path").alias("filename"), at("row", "col").alias("start"), at("end_row", "end_col").alias("end"))
    return F.struct("category", "severity", "message", span.alias("range"), "id")


_ISSUE = "category string, severity string, message string, range struct<filename: string, start: struct<row: int, column: int>, end: struct<row: int, column: int>>, id string"


def from_json(lines: DataFrame) -> DataFrame:
    """Issues of JSON lines (line), as as_record writes them; what isn't JSON is left out."""
    i = lines.select(F.from_json("line", _ISSUE).alias("i")).filter("i.id is not null or i.message is not null")
    r = lambda end, x: F.col(f"i.range.{end}.{x}")
    return i.select(F.col("i.range.filename").alias("path"), (r("start", "row") - 1).alias("row"), r("start", "column").alias("col"), (r("end", "row") - 1).alias("end_row"), r("end", "column").alias("end_col"), "i.id", "i.message", "i.category", "i.severity")


def report(issues: DataFrame, form: str = "text") -> DataFrame:
    """(line): an issue a line, as JSON or, whatever else is asked for, as text."""
    line = as_json(as_record(issues)) if form == "json" else as_text(F.col("path"), F.col("row"), F.col("col"), F.col("message"))
    return issues.select(line.alias("line"))


def in_order(issues: DataFrame) -> DataFrame:
    """By path, place and checker; a check by itself keeps no order between files."""
    return issues.orderBy("path", "row", "col", "end_row", "end_col", "id", "message")


def first_of_each(issues: DataFrame, *keys: str) -> DataFrame:
    """Of the issues of each key, a path or a path and a checker, the first by place."""
    rest = [c for c in issues.columns if c not in keys]
    least = issues.groupBy(*keys).agg(F.min(F.struct("row", "col", *(c for c in rest if c not in ("row", "col")))).alias("__f"))
    return least.select(*(F.col(c) if c in keys else F.col(f"__f.{c}") for c in issues.columns))


def count_by_checker(checkers: DataFrame, issues: DataFrame) -> DataFrame:
    n = issues.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return checkers.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("issues"))


def count_by(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def difference(expected: DataFrame, raised: DataFrame) -> DataFrame:
    """(file, line, expected, raised) where the sorted messages differ; an expected '' stands for any message."""
    lists = lambda df, name: df.groupBy("file", "line").agg(F.sort_array(F.collect_list("message")).alias(name))
    both = lists(expected, "expected").join(lists(raised, "raised"), ["file", "line"], "full_outer")
    same = (F.size("expected") == F.size("raised")) & F.forall(F.zip_with("expected", "raised", lambda e, r: (e == "") | (e == r)), lambda x: x)
    return both.filter(~F.coalesce(same, F.lit(False)))


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def changed_set(compared: DataFrame, working: DataFrame) -> DataFrame:
    """(path): of compared (path, state) what isn't deleted, and of working (path, state) what changed, without what is deleted there."""
    gone = working.filter("state = 'D'").select("path")
    all_ = compared.filter("state <> 'D'").select("path").union(working.filter("state not in ('D', ' ')").select("path"))
    return all_.distinct().join(gone, "path", "left_anti")


def nearest_enclosing(refs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each ref (file_id, pre, ...) with the innermost scope (file_id, pre, subtree_end, name) around it."""
    s = scopes.select(F.col("file_id").alias("s_file"), F.col("pre").alias("s_pre"), F.col("subtree_end").alias("s_end"))
    places = refs.select("file_id", "pre").distinct()
    met = places.join(s, (F.col("file_id") == F.col("s_file")) & (F.col("s_pre") <= F.col("pre")) & (F.col("pre") <= F.col("s_end")))
    return refs.join(met.groupBy("file_id", "pre").agg(F.max("s_pre").alias("scope")), ["file_id", "pre"], "left")


def tainted(assignments: DataFrame, seeds: list[str]) -> DataFrame:
    """(file_id, tainted): names that one forward pass over assignments (file_id, pos, lhs, rhs_names) taints."""
    steps = F.sort_array(F.collect_list(F.struct("pos", "lhs", "rhs_names")))
    fold = F.aggregate(steps, F.array(*(F.lit(s) for s in seeds)), lambda st, x: F.when(F.arrays_overlap(st, x["rhs_names"]), F.array_union(st, F.array(x["lhs"]))).otherwise(st))
    return assignments.groupBy("file_id").agg(F.sort_array(fold).alias("tainted"))
