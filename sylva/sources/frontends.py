"""Source files as trees and as a table of nodes, for every language that has a front end."""

from __future__ import annotations

import gc
import sys
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import partial
from itertools import islice, repeat

import pyarrow as pa
from pyspark.sql import DataFrame

from sylva.sources import generic, html
from sylva.sources.golang import Go
from sylva.sources.java import Java
from sylva.sources.javascript import JavaScript
from sylva.sources.python import Python
from sylva.sources.ruby import Ruby
from sylva.sources.smaller import Dockerfile, Php, Rust
from sylva.sources.syntax import N, rows

PARSERS: dict[str, Callable[[str], object]] = {
    "python": Python,
    "javascript": JavaScript,
    "typescript": JavaScript,
    "tsx": JavaScript,
    "go": Go,
    "java": Java,
    "ruby": Ruby,
    "php": Php,
    "rust": Rust,
    "dockerfile": Dockerfile,
    "html": html.Html,
    **{x: partial(generic.Generic, x) for x in generic.LANGUAGES},
}
NODES = "file_id bigint, lang string, node_id int, parent_id int, kind string, is_named boolean, field string, child_ix int, named_ix int, n_named int, depth int, pre int, subtree_end int, start_byte int, end_byte int, start_row int, start_col int, end_row int, end_col int, text string"
#: Bytes up to which a node's text is in the table; that of a longer inner node is the source between its bytes.
SHORT = 256
#: Files that are taken from a batch at once; rows and bytes, by estimate, from which on a batch goes out; bytes of the last results that a task keeps for equal sources, the length from which on a source's result isn't kept, and that from which on memory is cleared first.
AT_ONCE, ROWS, BYTES, KEPT, LONG, HUGE = 64, 20_000, 4 << 20, 16 << 20, 1 << 16, 1 << 20


def tree(lang: str, source: str | bytes | None) -> tuple[N, str] | None:
    """The tree and the source as one character a byte; None for a null source or a language without a front end."""
    if source is None or lang not in PARSERS:
        return None
    data = source.encode() if isinstance(source, str) else source
    src = data.decode("latin-1")
    return PARSERS[lang](src).parse(), src


def source_key(lang: str, source: str | bytes | None) -> tuple | None:
    """For per_source: what is parsed, None for what isn't."""
    return None if source is None or lang not in PARSERS else (lang, source)


def text_of(src: str, start: int, end: int) -> str:
    return src[start:end].encode("latin-1").decode(errors="replace")


def weight(values: Iterable) -> int:
    return sum(weight(x) if isinstance(x, list) else sys.getsizeof(x) for x in values)


def per_source(batches: Iterable[pa.RecordBatch], columns: list[str], n_own: int, schema: pa.Schema, key_of: Callable[..., Hashable], rows_of: Callable[..., Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
    """For each file, its first n_own `columns` before each row of rows_of(*key), where key is key_of(*its columns but the first),
    None for no rows. Equal keys give equal rows: they are made once while the task remembers them, so that copies aren't
    parsed again. Memory is bounded by the largest file, not by how many files are in a batch."""
    kept: OrderedDict[Hashable, tuple[list[tuple], int, int]] = OrderedDict()
    total = size = 0
    held: list[list] = [[] for _ in schema]

    def add(own: tuple, made: list[tuple], n: int) -> None:
        for to, value in zip(held, own, strict=False):
            to.extend(repeat(value, n))
        for to, values in zip(held[n_own:], made, strict=True):
            to.extend(values)

    def batch() -> pa.RecordBatch:
        nonlocal size
        out = pa.record_batch([pa.array(c, x.type) for c, x in zip(held, schema, strict=True)], schema=schema)
        for c in held:
            c.clear()
        size = 0
        return out

    for b in batches:
        some = b.select(columns)
        at_once = max(1, min(AT_ONCE, BYTES * b.num_rows // max(1, some.nbytes)))
        for start in range(0, b.num_rows, at_once):
            for file in zip(*(c.to_pylist() for c in some.slice(start, at_once).columns), strict=True):
                key = key_of(*file[1:])
                if key is None:
                    continue
                if key in kept:
                    kept.move_to_end(key)
                    made, n, mass = kept[key]
                    if n:
                        add(file[:n_own], made, n)
                else:
                    whole = len(file[-1]) < LONG
                    if len(file[-1]) > HUGE:
                        gc.collect()  # trees are cyclic: the one before goes first
                    rows = iter(rows_of(*key))
                    while part := list(rows if whole else islice(rows, ROWS)):
                        made, n = list(zip(*part, strict=True)), len(part)
                        mass = sum(map(weight, made))
                        add(file[:n_own], made, n)
                        if whole:
                            break
                        size += mass
                        if len(held[0]) >= ROWS or size >= BYTES:
                            yield batch()
                    if not whole:
                        continue
                    if not part:
                        made, n, mass = [], 0, 0
                    kept[key] = made, n, mass
                    total += mass + sys.getsizeof(file[-1])
                    while total > KEPT:
                        old, (_, _, less) = kept.popitem(last=False)
                        total -= less + sys.getsizeof(old[1])
                size += mass
                if len(held[0]) >= ROWS or size >= BYTES:
                    yield batch()
    if held[0]:
        yield batch()


def nodes(files: DataFrame) -> DataFrame:
    """(file_id, lang, source) -> nodes in preorder, in one pass without a shuffle. Null sources and languages without a front
    end have no nodes; what can't be read is an ERROR node. text is null for inner nodes of more than SHORT bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in NODES.split(", ")])

        def own(lang: str, source: str | bytes) -> Iterator[tuple]:
            root, src = tree(lang, source)
            for r in rows(root, src):
                start, end = r[11], r[12]
                yield *r, text_of(src, start, end) if end - start <= SHORT or r[10] == r[9] else None

        return per_source(batches, ["file_id", "lang", "source"], 2, schema, source_key, own)

    return files.select("file_id", "lang", "source").mapInArrow(run, NODES)
