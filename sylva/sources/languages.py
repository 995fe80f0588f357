"""The languages that files are told apart by, as a small dimension and as column expressions."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (identifiers, extensions, comment mark as a regular expression, whether there is a grammar)
LANGUAGES: dict[str, tuple[list[str], list[str], str, bool]] = {
    "python": (["python", "py"], [".py"], "#", True),
    "javascript": (["javascript", "js"], [".js", ".jsx"], r"\/\/", True),
    "typescript": (["typescript", "ts"], [".ts"], r"\/\/", True),
    "tsx": (["jsx", "tsx"], [".tsx"], r"\/\/", True),
    "java": (["java"], [".java"], r"\/\/", True),
    "ruby": (["ruby", "rb"], [".rb"], "#", True),
    "rust": (["rust", "rs"], [".rs"], r"\/\/", True),
    "yaml": (["yaml", "yml"], [".yaml", ".yml"], "#", False),
    "css": (["css", "css3"], [".css"], r"\/\/", True),
    "dockerfile": (["docker", "dockerfile"], [".dockerfile", ".Dockerfile"], "#", True),
    "markdown": (["markdown", "md"], [".md"], r"\/\/", False),
    "sql": (["sql"], [".sql"], "--", True),
    "kotlin": (["kotlin", "kt"], [".kt"], r"\/\/", True),
    "ocaml": (["ocaml", "ml"], [".ml"], r"\(\*", True),
    "lua": (["lua"], [".lua"], "#", True),
    "bash": (["sh", "bash"], [".sh"], "#", True),
    "csharp": (["csharp", "cs"], [".cs"], r"\/\/", True),
    "elixir": (["elixir", "ex"], [".ex"], "#", True),
    "elm": (["elm"], [".elm"], "--", True),
    "go": (["go"], [".go"], r"\/\/", True),
    "groovy": (["groovy"], [".groovy"], r"\/\/", True),
    "hcl": (["hcl", "tf"], [".tf"], "#", True),
    "html": (["html"], [".html"], r"<\!--", True),
    "php": (["php"], [".php"], r"\/\/", True),
    "scala": (["scala"], [".scala"], r"\/\/", True),
    "swift": (["swift"], [".swift"], r"\/\/", True),
}
_BY_EXTENSION = {e: n for n, (_, es, _, _) in LANGUAGES.items() for e in es}
_BY_IDENTIFIER = {i: n for n, (ids, _, _, _) in LANGUAGES.items() for i in ids}
IGNORED_DIRS = ("node_modules", "vendor", "dist", "build", "out", ".git", ".svn", "venv", "__pycache__", ".idea", ".vitepress")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def detect(path: Column) -> Column:
    """Language by extension, case and all; null where it is unknown."""
    return _lookup(_BY_EXTENSION, extension(path))


def decode(identifier: Column) -> Column:
    return _lookup(_BY_IDENTIFIER, F.lower(identifier))


def comment_mark(lang: Column) -> Column:
    return F.coalesce(_lookup({n: c for n, (_, _, c, _) in LANGUAGES.items()}, lang), F.lit(""))


def test_extension(lang: Column) -> Column:
    return _lookup({n: (".Dockerfile" if n == "dockerfile" else es[0]) for n, (_, es, _, _) in LANGUAGES.items() if n != "markdown"}, lang)


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *v) for n, v in LANGUAGES.items()], "lang string, identifiers array<string>, extensions array<string>, comment string, grammar boolean")


_FILE = "path string, lang string, n_bytes bigint"


def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang, n_bytes) of the files of known languages below root, paths relative to it, in order. Directories of an
    ignored name aren't entered, symbolic links not followed, no content is read. Names that Spark's own file sources pass
    over, as those that begin with _, are seen. The driver lists, as it does for those sources."""
    system, base = _filesystem(root)
    local = isinstance(system, fs.LocalFileSystem)
    found, open_ = [], [base.rstrip("/")]
    while open_:
        for i in system.get_file_info(fs.FileSelector(open_.pop(), recursive=False)):
            if local and os.path.islink(i.path):
                continue
            if i.type == fs.FileType.Directory:
                if i.base_name not in IGNORED_DIRS:
                    open_.append(i.path)
            elif i.type == fs.FileType.File:
                dot = i.base_name.rfind(".")
                lang = _BY_EXTENSION.get(i.base_name[dot:]) if dot >= 0 else None
                if lang:
                    found.append((i.path[len(base.rstrip("/")) + 1 :], lang, i.size))
    found.sort()
    columns = [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]
    return spark.createDataFrame(pa.table({"path": pa.array(columns[0], pa.string()), "lang": pa.array(columns[1], pa.string()), "n_bytes": pa.array(columns[2], pa.int64())}), _FILE)


def read_tree(spark: SparkSession, root: str, kept: Column | None = None, part_bytes: int = 64 << 20) -> DataFrame:
    """source_files (file_id, path, lang, source, n_bytes) below root: files whose path and lang pass `kept`, read by tasks of
    about part_bytes each; no other file is opened. Sources that aren't UTF-8 have replaced characters; a file that is gone has
    a null source."""
    listed = list_tree(spark, root)
    if kept is not None:
        listed = listed.filter(kept)
    size = listed.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(min(spark.sparkContext.defaultParallelism, size // (1 << 16) + 1), -(-size // part_bytes))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(root)
        for b in batches:
            held: list[str | None] = []
            start = n = 0
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with system.open_input_file(f"{base.rstrip('/')}/{path}") as f:
                        held.append(f.read().decode(errors="replace"))
                except FileNotFoundError:
                    held.append(None)
                n += len(held[-1] or "")
                if n > 4 << 20 or i == b.num_rows - 1:
                    yield b.slice(start, len(held)).append_column("source", pa.array(held, pa.string()))
                    start, n, held = i + 1, 0, []

    out = listed.repartition(parts).mapInArrow(read, f"{_FILE}, source string")
    return out.select(F.xxhash64("path").alias("file_id"), "path", "lang", "source", "n_bytes")
