"""Table functions over source files: variables of scopes, edges of data flow, matches of patterns, functions. No shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.plans.pattern import File, PatternSyntaxError, parse
from sylva.plans.scopes import DataFlow, Scopes
from sylva.sources.frontends import per_source, source_key, tree
from sylva.sources.syntax import Lines

_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def per_file(files: DataFrame, columns: str, rows_of: Callable[[File], Iterable[tuple]]) -> DataFrame:
    """(file_id, then `columns`) of what rows_of gives for each parsed file (file_id, lang, source); unparsed ones give nothing."""
    schema = pa.schema([("file_id", pa.int64()), *((x.rsplit(" ", 1)[0], _TYPES[x.rsplit(" ", 1)[1]]) for x in columns.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return per_source(batches, ["file_id", "lang", "source"], 1, schema, source_key, lambda lang, source: rows_of(File(*tree(lang, source))))

    return files.select("file_id", "lang", "source").mapInArrow(run, f"file_id bigint, {columns}")


def variables(files: DataFrame) -> DataFrame:
    """(file_id, scope, name, kind, row, refs, exported): each variable of JavaScript files; scope is its node's preorder rank."""

    def own(f: File) -> Iterator[tuple]:
        lines = Lines(f.src)
        for scope, v in f.ask(Scopes).all():
            yield scope.node.pre, v.name, v.kind, lines.at(v.decl.start)[0], len(v.refs), v.exported

    return per_file(files, "scope int, name string, kind string, row int, refs int, exported boolean", own)


def flows(files: DataFrame) -> DataFrame:
    """(file_id, name, source): the variables that a variable's last value is made of directly."""

    def own(f: File) -> Iterator[tuple]:
        for v, flow in f.ask(DataFlow).graph.items():
            for s in flow.sources:
                yield v.name, s.variable.name

    return per_file(files, "name string, source string", own)


def functions(files: DataFrame) -> DataFrame:
    """(file_id, name, row): of the definitions of a function's name the last."""

    def own(f: File) -> Iterator[tuple]:
        lines = Lines(f.src)
        for name, fn in f.ask(DataFlow).functions.items():
            yield name, lines.at(fn.node.start)[0]

    return per_file(files, "name string, row int", own)


def matches(files: DataFrame, text: str, report: str) -> DataFrame:
    """(file_id, row, col, text, captures): a row for each match and node captured as `report`; captures are name and text by turns."""
    patterns = parse(text)
    if not any(f"@{report}" in text[i : i + len(report) + 1] for i in range(len(text))):
        raise PatternSyntaxError(f"nothing is captured as @{report}")

    def own(f: File) -> Iterator[tuple]:
        lines = Lines(f.src)
        for p in patterns:
            for b in f.matches(p):
                texts = [f.text(n) for _, n in b]
                flat = [x for (c, _), text in zip(b, texts, strict=True) for x in (c, text)]
                for (c, n), text in zip(b, texts, strict=True):
                    if c == report:
                        yield *lines.at(n.start), text, flat

    return per_file(files, "row int, col int, text string, captures array<string>", own)


def previous_siblings(nodes: DataFrame) -> DataFrame:
    """nodes with `previous`: the node_id of the sibling before, null for a first child."""
    return nodes.withColumn("previous", F.lag("node_id").over(Window.partitionBy("file_id", "parent_id").orderBy("child_ix")))
