"""Checkers: declarative ones from YAML, written ones as functions; all of a language run on a file where it is parsed.

The plan has no shuffle: files are filtered by language and path in the scan, then each is parsed once and
every checker of its language looks at the one tree. Suppression comments are read from the same tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import glob_regex
from sylva.plans.pattern import File, Pattern, ancestors, parse
from sylva.sources.frontends import PARSERS, per_source, source_key, tree
from sylva.sources.languages import _BY_IDENTIFIER
from sylva.sources.syntax import Lines, N

CATEGORIES = {"style", "bug-risk", "antipattern", "performance", "security"}
SEVERITIES = {"critical", "error", "warning", "info"}
ISSUES = "file_id bigint, path string, lang string, row int, col int, end_row int, end_col int, id string, message string, category string, severity string"
_SKIP = re.compile(r"(?i)\bskipcq\b(?::\s*([A-Za-z\-_0-9]+(?:\s*,\s*[A-Za-z\-_0-9]+)*))?")


@lru_cache(1000)
def _any_glob(globs: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(glob_regex, globs)))


@dataclass
class Checker:
    """patterns: for declarative ones. run: file -> (node, message); it may ask `file` for what other checkers need too."""

    id: str
    lang: str
    message: str = ""
    patterns: list[Pattern] = field(default_factory=list)
    category: str = ""
    severity: str = ""
    description: str = ""
    filters: list[tuple[bool, list[Pattern]]] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    run: Callable[[File], Iterator[tuple[N, str]]] | None = None
    origin: str = "custom"
    requires: list[Checker] = field(default_factory=list)

    def wants(self, path: str) -> bool:
        if self.include and not _any_glob(tuple(self.include)).match(path):
            return False
        return not (self.exclude and _any_glob(tuple(self.exclude)).match(path))

    def found(self, f: File) -> Iterator[tuple[N, str]]:
        if self.run is not None:
            yield from self.run(f)
            return
        bounds = [(keep, {n.pre for p in ps for b in f.matches(p) for c, n in b if c == _WITHIN}) for keep, ps in self.filters]
        for p in self.patterns:
            for b in f.matches(p):
                for c, n in b:
                    if c == self.id and all(any(a.pre in pres for a in ancestors(n)) == keep for keep, pres in bounds):
                        message = self.message
                        for name, x in b:
                            if "@" in message:
                                message = message.replace("@" + name, f.text(x))
                        yield n, message


def closure(checkers: list[Checker]) -> list[Checker]:
    """Checkers, each after what it requires; one that several require is there as often."""
    return [x for c in checkers for x in (*closure(c.requires), c)]


_WITHIN = "__filter__key__"


def within(text: str) -> list[Pattern]:
    """A filter's patterns; the last one's root is what must be around."""
    return parse(text.rstrip() + f" @{_WITHIN}")


def load(text: str) -> Checker:
    """Unknown keys, categories and severities are let through; a checker needs name, language, message and patterns of one kind."""
    y = yaml.safe_load(text) or {}
    lang = _BY_IDENTIFIER.get(str(y.get("language", "")).lower())
    if lang is None:
        raise ValueError(f"unknown language {y.get('language')!r}")
    if not y.get("name") or not y.get("message"):
        raise ValueError("a checker needs a name and a message")
    if bool(y.get("pattern")) == bool(y.get("patterns")):
        raise ValueError("a checker needs either pattern or patterns")
    texts = [y["pattern"]] if y.get("pattern") else list(y["patterns"])
    c = Checker(y["name"], lang, y["message"], [p for t in texts for p in parse(t)], y.get("category") or "", y.get("severity") or "", y.get("description") or "", include=list(y.get("include") or []), exclude=list(y.get("exclude") or []))
    for f in y.get("filters") or []:
        c.filters += [(k == "pattern-inside", within(v)) for k, v in f.items() if k in ("pattern-inside", "pattern-not-inside") and v]
    for g in [*c.include, *c.exclude]:
        try:
            re.compile(glob_regex(g))
        except re.error as e:
            raise ValueError(f"malformed glob {g!r}") from e
    return c


def valid(c: Checker) -> bool:
    """Whether category and severity are known ones; loading doesn't ask."""
    return c.category in CATEGORIES and c.severity in SEVERITIES


def suppressed(f: File, comments: tuple[str, ...] = ("comment", "line_comment", "block_comment")) -> dict[int, list[set[str] | None]]:
    """row -> what comments on it or on the row above skip there; None: everything."""
    out: dict[int, list[set[str] | None]] = {}
    for kind in comments:
        for n in f.by_kind.get(kind, ()):
            m = _SKIP.search(f.text(n))
            if m:
                ids = {x.strip() for x in m[1].split(",")} if m[1] else None
                row = f.src.count("\n", 0, n.start)
                for r in (row, row + 1):
                    out.setdefault(r, []).append(ids)
    return out


def issues_of(f: File, checkers: list[Checker], path: str = "", keep_skipped: bool = False) -> list[tuple]:
    """(row, col, end_row, end_col, id, message, category, severity), in order of checkers and matches; twice matched is twice reported."""
    return list(_issues(f, [c for c in checkers if c.wants(path)], keep_skipped))


def _issues(f: File, checkers: list[Checker], keep_skipped: bool) -> Iterator[tuple]:
    lines, skips = Lines(f.src), None
    for c in checkers:
        for n, message in c.found(f):
            if skips is None:
                skips = {} if keep_skipped else suppressed(f)
            row, col = lines.at(n.start)
            if any(ids is None or c.id in ids for ids in skips.get(row, ())):
                continue
            yield row, col, *lines.at(n.end), c.id, message, c.category, c.severity


def check(files: DataFrame, checkers: list[Checker], keep_skipped: bool = False) -> DataFrame:
    """Issues of files (file_id, path, lang, source), by every checker of their language. Rows count from 0. Null sources,
    languages without a front end or a checker, and an empty table have none; a file that repeats is reported each time, though
    looked at once, so a written checker must depend on the file alone."""
    by_lang: dict[str, list[Checker]] = {}
    for c in closure(checkers):
        by_lang.setdefault(c.lang, []).append(c)
    langs = [x for x in by_lang if x in PARSERS]
    shared = files.sparkSession.sparkContext.broadcast(by_lang)  # as large as the rules, not the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ISSUES.split(", ")])
        rules = shared.value

        def key(path: str | None, lang: str, source: str | bytes | None) -> tuple | None:
            some = tuple(i for i, c in enumerate(rules.get(lang, ())) if c.wants(path or ""))
            return (lang, source, some) if some and source_key(lang, source) else None

        def own(lang: str, source: str | bytes, some: tuple[int, ...]) -> Iterator[tuple]:
            return _issues(File(*tree(lang, source)), [rules[lang][i] for i in some], keep_skipped)

        return per_source(batches, ["file_id", "path", "lang", "source"], 3, schema, key, own)

    wanted = files.filter(F.col("lang").isin(*langs) & F.col("source").isNotNull()) if langs else files.filter(F.lit(False))
    return wanted.select("file_id", "path", "lang", "source").mapInArrow(run, ISSUES)
