"""Benchmark decontamination by latent semantic retrieval.

Every document is cut into passages. A sparse sign sketch of their TF-IDF matrix, summed
over the cluster, gives by a randomised singular value decomposition the leading
directions of term space; passages and benchmark items are compared by cosine there.
Pairs that are close enough are verified on their tokens: by the length of their longest
common subsequence, and by whether the item's answer, its closing words, stands in the
passage. Before a common subsequence is computed it's bounded by the number of the item's
tokens that the passage holds at all, chunk by chunk for all items at once, then exactly
for those that are left, which loses nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm._shared import DOCUMENTS, documents, only, row_key, small, stored
from sylva.llm._tokens import binaries, mix, slices, tokenize

#: Tokens in a chunk; a passage is two neighbouring chunks. Hash buckets of terms. Rows of the sketch; directions kept.
CHUNK, TERMS, SKETCH, RANK = 32, 1 << 14, 128, 64
#: Least cosine of a candidate; least share of an item in the common subsequence alone, and with the answer; the answer's tokens.
COSINE, COMMON, WITH_ANSWER, ANSWER = 0.3, 0.75, 0.5, 6
#: An item of fewer tokens is a phrase that any text may hold and isn't looked for. Items that one pass over the corpus looks for.
LEAST, BLOCK = 8, 5_000
_PAD, _WORD, _TILE = 0xFFFF, 64, 256
_CELLS = SKETCH * TERMS


def _ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(_PAD)).astype(np.uint16)


def _tokenized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token ids of each document, padded to whole chunks; last, the chunk counts of terms and of chunks."""
    df, chunks = np.zeros(TERMS, np.int64), 0
    for whole in batches:
        for b in slices(whole, "text"):
            t = tokenize(b.column("text"))
            size = np.diff(t.offs)
            held = -(-size // CHUNK) * CHUNK
            offs = np.concatenate([[0], np.cumsum(held)])
            ids = np.full(offs[-1], _PAD, np.uint16)
            ids[np.arange(len(t.hash)) + np.repeat(offs[:-1] - t.offs[:-1], size)] = _ids(t.hash)
            for part in np.array_split(ids.reshape(-1, CHUNK), len(ids) // (CHUNK << 12) + 1):
                grid = np.sort(np.where(part == _PAD, _PAD, part & (TERMS - 1)).astype(np.uint16), 1)
                new = grid != _PAD
                new[:, 1:] &= grid[:, 1:] != grid[:, :-1]
                df += np.bincount(grid[new], minlength=TERMS)
                chunks += len(grid)
            yield pa.record_batch({"kind": pa.array(np.zeros(len(size), np.int32)), "row": b.column("row"), "doc_id": b.column("doc_id"), "ids": binaries(ids, offs)})
    yield pa.record_batch({"kind": pa.array([1], pa.int32()), "row": pa.array([None], pa.string()), "doc_id": pa.array([None], pa.int64()), "ids": pa.array([np.append(df, chunks).tobytes()], pa.binary())})


def _total(parts: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], dtype: type, cells: int, rows: int) -> np.ndarray:
    """The sum of the arrays that make yields of parts' partitions. Partitions are taken together until
    there are twice as many as cores, so that what is shuffled follows the cluster and not the input;
    each of the arrays' rows is summed in a task of its own."""
    spark = parts.sparkSession
    wide = -(-cells // rows)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * rows, dtype)
        for x in make(batches):
            total[:cells] += x
        for r in range(rows):
            row = total[r * wide : (r + 1) * wide]
            if row.any():
                yield pa.record_batch({"r": pa.array([r], pa.int32()), "v": pa.array([row.tobytes()], pa.binary())})

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, v in zip(b.column("r").to_pylist(), b.column("v"), strict=True):
                x = np.frombuffer(v.as_buffer(), dtype)
                held[r] = held[r] + x if r in held else x.copy()
        if held:
            yield pa.record_batch({"r": pa.array(list(held), pa.int32()), "v": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    few = parts.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(add, "r int, v binary")
    out = np.zeros((rows, wide), dtype)
    for r in few.repartition(min(rows, spark.sparkContext.defaultParallelism), "r").mapInArrow(join, "r int, v binary").toLocalIterator():
        out[r.r] = np.frombuffer(r.v, dtype)
    return out.ravel()[:cells]


def _idf(df: np.ndarray, chunks: int) -> np.ndarray:
    """Weights of token ids, smoothed, so that a term of all chunks still weighs a little; padding weighs nothing."""
    w = np.log((1.5 + chunks) / (1 + df)).astype(np.float32)
    full = np.tile(w, (_PAD + 1) // TERMS)
    full[_PAD] = 0
    return full


def _held(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray]]]]:
    """Documents' ids, in lots of about `most` tokens, with the index of each in its batch."""
    for b in batches:
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, x in enumerate(b.column("ids")):
            raw = x.as_buffer()
            held.append((i, np.frombuffer(raw, np.uint16)))
            size += raw.size // 2
            if size > most:
                yield b, held
                held, size = [], 0
        if held:
            yield b, held


def _sketch(idf_of: Callable[[], np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]]:
    """S, SKETCH x TERMS: each passage's scaled weights, added with its sign to its row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        idf, two = idf_of(), 2 * CHUNK
        for _, held in _held(batches, 1 << 19):
            grid = np.full((sum(-(-len(x) // two) for _, x in held), two), _PAD, np.uint16)
            flat, at = grid.ravel(), 0
            for _, x in held:
                flat[at : at + len(x)] = x
                at += -(-len(x) // two) * two
            total = np.zeros(_CELLS, np.float32)
            for g in np.array_split(grid, len(grid) // 4096 + 1):
                w = idf[g]
                norm = np.sqrt((w * w).sum(1))
                h = mix(g.astype(np.uint64).sum(1) * np.uint64(0x9E3779B97F4A7C15) + g[:, 0])
                w *= np.where(h >> np.uint64(63), 1, -1)[:, None] / np.maximum(norm, 1e-6)[:, None]
                cell = (h % np.uint64(SKETCH)).astype(np.int64)[:, None] * TERMS + (g & (TERMS - 1))
                np.add.at(total, cell[w != 0], w[w != 0])
            yield total

    return run


@dataclass
class Index:
    """project: a token's part of its passage's place in latent space, whitened. Items of one block: pieces
    of at most 64 tokens, as even as can be; whose: the item of each piece; lengths, answers: by item."""

    project: np.ndarray
    ids: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    answers: list[np.ndarray] = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)  # tiles: the first piece, rows of tokens, how often pieces hold these, least bounds
    whose: list[int] = field(default_factory=list)
    places: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))
    endings: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # sorted hashes of answers, and whose they are
    tiles: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def place(self, ids: np.ndarray) -> np.ndarray:
        return self.project[np.where(ids == _PAD, TERMS, ids & (TERMS - 1))].sum(-2)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def directions(sketch: np.ndarray, idf: np.ndarray) -> np.ndarray:
    s = sketch.reshape(SKETCH, TERMS).astype(np.float64)
    value, vector = np.linalg.eigh(s @ s.T)
    top = np.argsort(-value)[:RANK]
    top = top[value[top] > max(1e-9, value.max() * 1e-9)]
    right = (s.T @ vector[:, top]) / np.sqrt(value[top])
    project = np.zeros((TERMS + 1, RANK), np.float32)
    project[:TERMS, : len(top)] = idf[:TERMS, None] * right / np.sqrt(value[top])
    return project


def index(project: np.ndarray, items: list[tuple[int, str]]) -> Index:
    out = Index(project)
    places = []
    t = tokenize(pa.array([x for _, x in items], pa.string()))
    for (item, _), a, b in zip(items, t.offs[:-1], t.offs[1:], strict=True):
        ids = _ids(t.hash[a:b])
        if len(ids) < LEAST:
            continue
        for piece in np.array_split(ids, -(-len(ids) // _WORD)):
            out.tokens.append(piece)
            out.whose.append(len(out.ids))
            places.append(out.place(piece))
        out.ids.append(item)
        out.lengths.append(len(ids))
        out.answers.append(ids[-ANSWER:])
    if places:
        out.places = _unit(np.array(places, np.float32))
    for first in range(0, len(out.tokens), _TILE):
        some = out.tokens[first : first + _TILE]
        vocabulary = np.unique(np.concatenate(some))
        row = np.zeros(1 << 16, np.uint16)
        row[vocabulary] = np.arange(1, len(vocabulary) + 1)
        counts = np.zeros((len(vocabulary) + 1, len(some)), np.uint8)
        for k, piece in enumerate(some):
            np.add.at(counts, (row[piece], k), 1)
        need = [COMMON if out.lengths[w] <= _WORD else WITH_ANSWER for w in out.whose[first : first + _TILE]]
        out.tiles.append((first, row, counts, np.ceil(np.array([n * len(p) for n, p in zip(need, some, strict=True)]) - 1e-9).astype(np.int16)))
    order = np.argsort(ends := _run_hashes(np.concatenate([out.tokens[w][-ANSWER:] for w in np.cumsum(np.bincount(out.whose)) - 1])) if out.ids else np.zeros(0, np.uint64), kind="stable")
    out.endings = ends[order], order
    return out


def _run_hashes(tokens: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of ANSWER tokens each: of a grid's rows, or from each place of a row on."""
    wide = tokens.reshape(-1, ANSWER) if at is None else tokens[at[:, None] + np.arange(ANSWER)]
    h = np.zeros(len(wide), np.uint64)
    for j in range(ANSWER):
        h = (h + wide[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def _bits(item: np.ndarray, table: np.ndarray) -> None:
    for i, x in enumerate(item):
        table[x] |= np.uint64(1) << np.uint64(i)


def common(item: np.ndarray, texts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Longest common subsequences of an item of at most 64 tokens with each row of texts, bit-parallel.
    table: 65536 zeros, returned as such."""
    _bits(item, table)
    v = np.full(len(texts), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(texts.shape[1]):
        m = table[texts[:, j]]
        u = v & m
        v = (v + u) | (v & ~m)
    table[item] = 0
    used = np.uint64((1 << len(item)) - 1)
    return np.bitwise_count(~v & used).astype(int)


def _search(index_of: Callable[[], Index]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index_of()
        table = np.zeros(1 << 16, np.uint64)
        for b, held in _held(batches, 1 << 17):
            found = _hits(ix, held, table)
            if found:
                at = pa.array([i for i, _ in found])
                yield pa.record_batch(
                    {
                        "row": b.column("row").take(at),
                        "doc_id": b.column("doc_id").take(at),
                        "item_id": pa.array([ix.ids[k] for _, k in found], pa.int64()),
                        "common": pa.array([x[0] for x in found.values()]),
                        "cosine": pa.array([x[1] for x in found.values()]),
                        "answer": pa.array([x[2] for x in found.values()]),
                    }
                )

    return run


def _hits(ix: Index, held: list, table: np.ndarray) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """(document, item) -> share of the item in common subsequences, cosine, whether the answer is there."""
    if not ix.ids:
        return {}
    grid = np.concatenate([x for _, x in held]).reshape(-1, CHUNK)
    if not len(grid):
        return {}
    owner = np.repeat([i for i, _ in held], [len(x) // CHUNK for _, x in held])
    place = np.concatenate([ix.place(g) for g in np.array_split(grid, len(grid) // 512 + 1)])
    follows = np.concatenate([owner[1:] == owner[:-1], [False]])
    pair = place.copy()
    pair[follows] += place[1:][follows[:-1]]
    pair, place = _unit(pair), _unit(place)
    edge = np.full((1, CHUNK), _PAD, np.uint16)
    wide = np.concatenate([grid, edge, edge])
    own = np.concatenate([owner, [-1, -1]])
    ends, whose = ix.endings
    flat = grid.ravel()
    answered = np.zeros((0, 2), np.int64)
    if len(flat) >= ANSWER:
        h = _run_hashes(flat, np.arange(len(flat) - ANSWER + 1))
        i = np.minimum(np.searchsorted(ends, h), len(ends) - 1)
        hit = np.flatnonzero(ends[i] == h)
        answered = np.array([(p // CHUNK, whose[k]) for p in hit for k in range(i[p], np.searchsorted(ends, h[p], "right"))], np.int64).reshape(-1, 2)
    best: dict[tuple[int, int], dict[int, tuple[int, float, bool]]] = {}
    lone = np.sort(grid, 1)
    lone[:, 1:][lone[:, 1:] == lone[:, :-1]] = _PAD
    for first, row, counts, least in ix.tiles:
        near = np.maximum(pair @ ix.places[first : first + _TILE].T, place @ ix.places[first : first + _TILE].T)
        rows = row[lone]
        has = np.zeros((len(grid) + 2, len(least)), np.int16)
        for part in np.array_split(np.arange(len(grid)), len(grid) // 1024 + 1):
            here = np.zeros((len(part), len(least)), np.uint8)
            for j in range(CHUNK):
                here += np.take(counts, rows[part, j], 0)
            has[part] = here
        bound = has[:-2].copy()
        for d in (1, 2):
            bound += np.where((own[d : len(grid) + d] == owner)[:, None], has[d : len(grid) + d], np.int16(0))
        near[:-1] = np.maximum(near[:-1], np.where(follows[:-1, None], near[1:], -1))
        some = bound >= least
        for at, who in answered:  # with the answer there, less is enough, in the windows that reach it
            for k in range(max(first, bisect.bisect_left(ix.whose, who)), min(first + len(least), bisect.bisect_right(ix.whose, who))):
                for i in range(max(0, at - 2), at + 1):
                    some[i, k - first] |= bound[i, k - first] >= WITH_ANSWER * len(ix.tokens[k])
        some &= near >= COSINE
        at_all, k_all = np.nonzero(some)
        order = np.argsort(k_all, kind="stable")
        at_all, k_all = at_all[order], k_all[order]
        cut = np.flatnonzero(np.concatenate([[True], k_all[1:] != k_all[:-1]])) if len(k_all) else []
        cut = [*cut, len(k_all)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            k, at = first + int(k_all[x]), at_all[x:y]
            item, answer = ix.tokens[k], ix.answers[ix.whose[k]].tobytes()
            text = np.concatenate([np.where((own[at + d] == owner[at])[:, None], wide[at + d], _PAD) for d in range(3)], 1)
            _bits(item, table)
            enough = np.bitwise_count(np.bitwise_or.reduce(table[text], 1)) >= WITH_ANSWER * len(item)
            table[item] = 0
            at, text = at[enough], text[enough]
            if not len(at):
                continue
            length = common(item, text, table)
            for i in np.flatnonzero(length >= WITH_ANSWER * len(item)):
                parts = best.setdefault((int(owner[at[i]]), ix.whose[k]), {})
                was = parts.get(k, (0, 0.0, False))
                parts[k] = max(was[0], int(length[i])), max(was[1], float(near[at[i], k - first])), was[2] or answer in text[i].tobytes()
    out = {}
    for (doc, item), parts in best.items():
        share = sum(x[0] for x in parts.values()) / ix.lengths[item]
        found = any(x[2] for x in parts.values())
        if share >= COMMON or found and share >= WITH_ANSWER:
            out[doc, item] = share, max(x[1] for x in parts.values()), found
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, common, cosine, answer): documents and the benchmark items that they hold.

    common is the share of the item's tokens in the longest common subsequence with a passage. An
    item of more than 64 tokens is looked for in even pieces; its share is that of all its tokens. Of
    items with one item_id the first text in order counts; items of fewer than LEAST tokens, null and
    empty texts, of either table, and null item_ids match nothing. Texts are searched whole, however
    long. A document has a row for each item it holds, ties too; repeated rows give repeated results;
    an empty table, of either kind, gives none. The benchmark is searched for in blocks of BLOCK items.
    """
    spark = docs.sparkSession
    d = only(docs, "doc_id", "text")
    d = d.select(row_key(d).alias("row"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    table = stored(d.mapInArrow(_tokenized, "kind int, row string, doc_id bigint, ids binary"), "tokens")

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield from (np.frombuffer(x.as_buffer(), np.int64) for x in b.column("ids"))

    df = _total(table.filter("kind = 1").select("ids"), counts, np.int64, TERMS + 1, 1)
    shared_idf = spark.sparkContext.broadcast(_idf(df[:-1], int(df[-1])))
    texts = table.filter("kind = 0 and length(ids) > 0").select("row", "doc_id", "ids")
    sketch = _total(texts.select("ids"), _sketch(lambda: shared_idf.value), np.float32, _CELLS, SKETCH)
    project = directions(sketch, shared_idf.value)
    bench = only(benchmark, "item_id", "text").dropna().groupBy(F.col("item_id").cast("bigint")).agg(F.min(F.col("text").cast("string")).alias("text"))
    bench = stored(bench, "benchmark")
    blocks = -(-bench.count() // BLOCK) or 1
    found = []
    for k in range(blocks):
        items = sorted((r[0], r[1]) for r in bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        shared = spark.sparkContext.broadcast(index(project, items))
        found.append(texts.mapInArrow(lambda x, s=shared: _search(lambda: s.value)(x), "row string, doc_id bigint, item_id bigint, common double, cosine double, answer boolean"))
    return reduce(DataFrame.union, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents, in their columns, that hold no benchmark item; null and empty texts stay."""
    docs = only(docs, *DOCUMENTS)
    bad = stored(leaks(docs, benchmark).select(F.col("row").alias("__row")).distinct(), "leaks")
    return docs.withColumn("__row", row_key(docs)).join(small(bad, 60), "__row", "left_anti").select(*DOCUMENTS)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id", "item_id").agg(F.max("common").alias("common"), F.max("cosine").alias("cosine"), F.max("answer").alias("answer"))
