"""N-gram Jaccard self-join of documents: every pair of different n-gram sets that meets the threshold is found.

Each n-gram is counted over all documents; hashes of 42 bits do, for a collision only adds a
candidate. A document can reach threshold t only if t of its n-grams occur elsewhere too, so most
documents leave here. Of the others, the repeated n-grams are put in one order for all, rarest
first. Two sets that meet the threshold share at least t of the n-grams of either, so the first
that they share lies among the first c - ceil(t * n) + 1 of either's c repeated ones: its prefix.
Sets are paired under each n-gram of both prefixes, unless their sizes, what is left of them from
there, or an equal n-gram just before (they meet there already) rule it out. Pairs are verified on
their full n-gram sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm._shared import DOCUMENTS, documents, only, row_key, small, spread_join, stored
from sylva.llm._tokens import binaries, mix, ngrams, over, sets, slices, tokenize
from sylva.llm.components import components

NGRAM, THRESHOLD = 3, 0.5
_LEAF, _TILE_PAIRS = 32, 200_000
#: Bits of an n-gram's hash that choose its part, in which it is counted; 32 more tell it from others there.
_PART_BITS = 10
#: Documents of one batch, at most; 16 bits number them.
_BATCH = 1 << 16
_SPREAD = "part int, batch bigint, at int, doc_id bigint, row string, sid binary, size int, data binary"
_ENTRY = np.dtype([("gram", "<u8"), ("before", "<u8"), ("node", "<i8"), ("size", "<u4"), ("left", "<u4")])


class CountRTree:
    """Bulk-loaded R-tree over count vectors. Entries are sorted by total count, so that nodes span
    few sizes, then cut into runs; every level keeps its nodes' upper corners and size ranges."""

    def __init__(self, points: np.ndarray, leaf: int = _LEAF):
        self.points, self.sizes, self.leaf = points.astype(np.int64), points.sum(1).astype(np.int64), leaf
        cells = np.arange(len(points))
        heavy = np.argmax(self.points, 1) if len(points) else cells
        self.order = np.lexsort((heavy, self.sizes))
        hi, lo_size, hi_size = self.points[self.order], self.sizes[self.order], self.sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(hi) > 1 or not self.levels:
            cut = np.arange(0, len(hi), leaf)
            if not len(cut):
                break
            hi, lo_size, hi_size = np.maximum.reduceat(hi, cut, 0), np.minimum.reduceat(lo_size, cut), np.maximum.reduceat(hi_size, cut)
            self.levels.append((hi, lo_size, hi_size))

    def query(self, i: int, threshold: float) -> np.ndarray:
        """Entries that may reach the threshold with entry i, by the bounds alone; i among them."""
        q, n, share = self.points[i], self.sizes[i], threshold / (1 + threshold)
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.zeros(0, int)
        for k in range(len(self.levels) - 1, -1, -1):
            hi, lo_size, hi_size = self.levels[k]
            ok = (hi_size[at] >= threshold * n - 1e-9) & (lo_size[at] * threshold <= n + 1e-9)
            at = at[ok]
            at = at[np.minimum(hi[at], q).sum(1) >= share * (n + lo_size[at]) - 1e-9]
            below = len(self.levels[k - 1][0]) if k else len(self.order)
            at = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            at = at[at < below]
        at = self.order[at]
        return at[np.minimum(self.points[at], q).sum(1) >= share * (n + self.sizes[at]) - 1e-9]


def _rows(schema: str, n: int, **columns: object) -> pa.RecordBatch:
    """A batch of n rows: the given columns, nulls in the others of the schema."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.record_batch({c: pa.nulls(n, kinds[k]) if columns.get(c) is None else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kinds[k]) for c, k in named})


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with a word, and for each batch and part the n-grams: 32 bits of hash and the document's distance from the one before."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for most in slices(whole, "text", 1 << 22):
            for first in range(0, most.num_rows, _BATCH):
                b = most.slice(first, _BATCH)
                cuts = [(sets(*(lambda g: (g[0], g[2]))(ngrams(tokenize(x.column("text")), NGRAM)))) for x in slices(b, "text")]
                grams = np.concatenate([g for g, _ in cuts])
                size = np.concatenate([np.diff(o) for _, o in cuts])
                if not len(grams):
                    continue
                offs = np.concatenate([[0], np.cumsum(size)])
                some = np.flatnonzero(size)
                sid = np.stack([mix(over(np.add, mix(grams, seed), offs, 0) + size.astype(np.uint64), seed) for seed in (7, 19)], 1)
                at = pa.array(some)
                number += 1
                yield _rows(_SPREAD, len(some), part=some % (1 << _PART_BITS), batch=np.full(len(some), number), at=some, doc_id=b.column("doc_id").take(at), row=b.column("row").take(at), sid=binaries(sid[some].ravel(), np.arange(len(some) + 1) * 2), size=size[some])
                part = (grams >> np.uint64(64 - _PART_BITS)).astype(np.int16)
                order = np.argsort(part, kind="stable")
                part, low, doc = part[order], grams[order].astype(np.uint32), np.repeat(np.arange(len(size)), size)[order]
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                step = np.diff(doc, prepend=0)
                step[starts] = doc[starts]
                low, near, far = low.view(np.uint8), (step & 255).astype(np.uint8), (step >> 8).astype(np.uint8)
                ends = np.append(starts[1:], len(part))
                data = [low[4 * s : 4 * e].tobytes() + near[s:e].tobytes() + far[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                yield _rows(_SPREAD, len(starts), part=part[starts].astype(np.int32), batch=np.full(len(starts), number), data=data)


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part's n-grams those that several documents have, with the logarithm of how many; rows of documents as they are."""
    for t in _groups(batches, "part"):
        parts, data = t.column("part").to_numpy(), t.column("data")
        counted = data.is_valid().to_numpy()
        if not counted.all():
            yield from t.filter(pa.array(~counted)).combine_chunks().to_batches()
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        for s, e in zip(starts, np.append(starts[1:], len(parts)), strict=True):
            rows = s + np.flatnonzero(counted[s:e])
            if not len(rows):
                continue
            raw = [np.frombuffer(data[int(i)].as_buffer(), np.uint8) for i in rows]
            lens = np.array([len(x) // 6 for x in raw])
            low = np.concatenate([x[: 4 * n].view("<u4") for x, n in zip(raw, lens, strict=True)])
            order = np.argsort(low)
            new = np.flatnonzero(np.concatenate([[True], low[order[1:]] != low[order[:-1]]]))
            times = np.empty(len(low), np.int64)
            times[order] = np.repeat(np.diff(np.append(new, len(low))), np.diff(np.append(new, len(low))))
            doc = np.concatenate([np.cumsum(x[4 * n : 5 * n].astype(np.int64) + (x[5 * n :].astype(np.int64) << 8)) for x, n in zip(raw, lens, strict=True)])
            many = times > 1
            kept = np.add.reduceat(many.astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))
            cut = np.concatenate([[0], np.cumsum(kept)])
            low, doc, rank = low[many].view(np.uint8), doc[many].astype("<u2").view(np.uint8), np.log2(times[many]).astype(np.uint8)
            has = np.flatnonzero(kept)
            out = [low[4 * x : 4 * y].tobytes() + doc[2 * x : 2 * y].tobytes() + rank[x:y].tobytes() for x, y in zip(cut[has], cut[has + 1], strict=True)]
            if out:
                yield _rows(_SPREAD, len(out), part=parts[rows[has]], batch=t.column("batch").to_numpy()[rows[has]], data=out)


def _prefixes(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "batch"):
            batch, data = t.column("batch").to_numpy(), t.column("data")
            counted = data.is_valid().to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))
            for s, e in zip(starts, np.append(starts[1:], len(batch)), strict=True):
                docs = t.slice(s, e - s).filter(pa.array(~counted[s:e])).combine_chunks()
                rows = s + np.flatnonzero(counted[s:e])
                raw = [np.frombuffer(data[int(i)].as_buffer(), np.uint8) for i in rows]
                lens = [len(x) // 7 for x in raw]
                none = [np.zeros(0, np.uint8)]
                low = np.concatenate([x[: 4 * n] for x, n in zip(raw, lens, strict=True)] + none).view("<u4")
                doc = np.concatenate([x[4 * n : 6 * n] for x, n in zip(raw, lens, strict=True)] + none).view("<u2")
                rank = np.concatenate([x[6 * n :] for x, n in zip(raw, lens, strict=True)] + none)
                gram = np.repeat(t.column("part").to_numpy()[rows].astype(np.uint64) << np.uint64(32), lens) | low
                order = np.lexsort((gram, rank, doc))
                gram, doc = gram[order], doc[order]
                at, size = docs.column("at").to_numpy(), docs.column("size").to_numpy()
                first, last = np.searchsorted(doc, at), np.searchsorted(doc, at, "right")
                shared = last - first
                prefix = np.maximum(shared - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, 0)
                cut = np.concatenate([[0], np.cumsum(prefix)])
                taken = gram[np.arange(cut[-1]) + np.repeat(first - cut[:-1], prefix)]
                yield pa.record_batch([*(docs.column(c).combine_chunks() for c in ("doc_id", "row", "sid", "size")), pa.array(shared.astype(np.int32)), binaries(taken, cut)], ["doc_id", "row", "sid", "size", "shared", "prefix"])

    return run


def signatures(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document with a word: doc_id, row key, 128-bit hash of its n-gram set (sid), the set's size,
    how many of it other documents have (shared) and the rarest of these, of which two sets that meet the threshold share one (prefix)."""
    d = only(docs, "doc_id", "text")
    d = d.select(F.col("doc_id").cast("bigint"), row_key(d).alias("row"), F.col("text").cast("string"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = d.mapInArrow(_spread, _SPREAD).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_repeated, _SPREAD)
    many = many.repartition(parts, "batch").sortWithinPartitions("batch")
    return many.mapInArrow(_prefixes(threshold), "doc_id bigint, row string, sid binary, size int, shared int, prefix binary")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """A row for each n-gram set: a number (node), its hash, rows, least of them in order of doc_id and row, size, shared n-grams and prefix."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    one = signed.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"), *(F.first(c).alias(c) for c in ("size", "shared", "prefix")))
    return stored(one.withColumn("node", F.monotonically_increasing_id()), "sets")


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of whole groups from batches that are sorted by key."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = t.column(key).to_numpy()
        first = int(np.argmax(k != k[-1])) if k[0] == k[-1] else len(k) - int(np.argmax(k[::-1] != k[-1]))
        if k[0] == k[-1]:
            if held and held[-1].column(key)[-1].as_py() != k[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(t)
            continue
        yield pa.concat_tables([*held, t.slice(0, first)])
        held = [t.slice(first)]
    if held:
        yield pa.concat_tables(held)


def _entries(parts: int):
    """The n-grams of each prefix, with the one before, the set's node and size and how many of its shared n-grams are left, by parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "prefix", 1 << 21):
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("prefix")]
                lens = np.array([len(x) for x in own])
                out = np.zeros(lens.sum(), _ENTRY)
                if not len(out):
                    continue
                out["gram"] = np.concatenate(own)
                starts = (np.cumsum(lens) - lens)[lens > 0]
                out["before"][1:] = out["gram"][:-1]
                out["node"], out["size"] = np.repeat(b.column("node").to_numpy(), lens), np.repeat(b.column("size").to_numpy(), lens)
                # a first n-gram has none before, and no two sets may seem to have the same
                out["before"][starts] = ~out["node"][starts].view(np.uint64)
                out["left"] = np.repeat(b.column("shared").to_numpy(), lens) - (np.arange(len(out)) - np.repeat(np.cumsum(lens) - lens, lens))
                part = (mix(out["gram"]) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, out = part[order], out[order]
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                yield pa.record_batch({"part": pa.array(part[cut]), "entries": pa.array([out[s:e].tobytes() for s, e in zip(cut, np.append(cut[1:], len(part)), strict=True)], pa.binary())})

    return run


def _candidates(threshold: float):
    share = threshold / (1 + threshold)

    def met(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = x[i], x[j]
        ok = (a["before"] != b["before"]) & (np.minimum(a["left"], b["left"]) >= share * (a["size"].astype(np.int64) + b["size"]) - 1e-9)
        m, n = a["node"][ok], b["node"][ok]
        return np.stack([np.minimum(m, n), np.maximum(m, n)], 1)

    def pairs(x: np.ndarray) -> Iterator[np.ndarray]:
        x = x[np.lexsort((x["size"], x["gram"]))]
        starts = np.flatnonzero(np.concatenate([[True], x["gram"][1:] != x["gram"][:-1]]))
        lens = np.diff(np.append(starts, len(x)))
        for n in np.unique(lens[(lens > 1) & (lens <= 2 * _LEAF)]):
            i, j = np.triu_indices(n, 1)
            at = starts[lens == n]
            for some in np.array_split(at, (len(at) * len(i) >> 17) + 1):
                yield met(x, (some[:, None] + i).ravel(), (some[:, None] + j).ravel())
        for s, n in zip(starts[lens > 2 * _LEAF], lens[lens > 2 * _LEAF], strict=True):
            end = s + np.searchsorted(x["size"][s : s + n], x["size"][s : s + n] / threshold + 1e-9, "right")
            for i in range(s, s + n - 1):
                for k in range(i + 1, int(end[i - s]), 1 << 17):
                    j = np.arange(k, min(k + (1 << 17), int(end[i - s])))
                    yield met(x, np.full(len(j), i), j)

    def once(held: list[np.ndarray]) -> np.ndarray:
        found = np.concatenate(held)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        return found[np.concatenate([[True], (found[1:] != found[:-1]).any(1)])] if len(found) else found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "part"):
            part = t.column("part").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            for s, e in zip(starts, np.append(starts[1:], len(part)), strict=True):
                held, n = [], 0
                for p in pairs(np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in t.column("entries").slice(s, e - s)])):
                    held.append(p)
                    n += len(p)
                    if n >= 1 << 21:
                        held = [once(held)]
                        n = len(held[0])
                        if n >= 1 << 20:
                            yield pa.record_batch({"a": pa.array(held[0][:, 0]), "b": pa.array(held.pop()[:, 1])})
                            n = 0
                if held:
                    found = once(held)
                    yield pa.record_batch({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            g, _, offs = ngrams(tokenize(b.column("text")), NGRAM)
            grams, offs = sets(g, offs)
            yield pa.record_batch({"node": b.column("node"), "grams": binaries(grams, offs)})


def _verify(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "tile"):
            tile, a, b = (t.column(c).to_numpy() for c in ("tile", "a", "b"))
            grams = t.column("grams")
            pair = grams.is_null().to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            for s, e in zip(starts, np.append(starts[1:], len(tile)), strict=True):
                docs, pairs = s + np.flatnonzero(~pair[s:e]), s + np.flatnonzero(pair[s:e])
                if not len(pairs):
                    continue
                docs = docs[np.argsort(a[docs])]
                own = [np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in docs]
                words, code = np.unique(np.concatenate(own), return_inverse=True)
                lens = np.array([len(x) for x in own])
                cut = np.concatenate([[0], np.cumsum(lens)])
                marked = np.zeros(len(words), bool)
                pairs = pairs[np.argsort(a[pairs], kind="stable")]
                left, right = np.searchsorted(a[docs], a[pairs]), np.searchsorted(a[docs], b[pairs])
                runs = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
                for r, q in zip(runs, np.append(runs[1:], len(left)), strict=True):
                    x = left[r]
                    mine = code[cut[x] : cut[x + 1]]
                    marked[mine] = True
                    for some in np.array_split(np.arange(r, q), (int(lens[right[r:q]].sum()) >> 20) + 1):
                        if not len(some):
                            continue
                        y = right[some]
                        first = np.concatenate([[0], np.cumsum(lens[y])])
                        at = np.arange(first[-1]) + np.repeat(cut[y] - first[:-1], lens[y])
                        both = np.add.reduceat(marked[code[at]].astype(np.int64), first[:-1])
                        j = both / (lens[x] + lens[y] - both)
                        ok = j >= threshold
                        if ok.any():
                            yield pa.record_batch({"a": pa.array(a[pairs[some[ok]]]), "b": pa.array(b[pairs[some[ok]]]), "jaccard": pa.array(j[ok])})
                    marked[mine] = False

    return run


def set_pairs(docs: DataFrame, one: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) for each pair of nodes, distinct n-gram sets, of at least the threshold, a < b."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    able = one.filter("octet_length(prefix) > 0").select("node", "size", "shared", "prefix")
    met = able.mapInArrow(_entries(parts), "part int, entries binary").repartition(parts, "part").sortWithinPartitions("part")
    pairs = stored(met.mapInArrow(_candidates(threshold), "a bigint, b bigint").distinct(), "pairs")

    near = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    hubs = stored(near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("hub")), "hubs")
    tiled = pairs.join(small(hubs, 16), pairs["a"] == hubs["x"]).select("a", "b", "hub")
    sides = tiled.groupBy("hub").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / _TILE_PAIRS)).cast("int").alias("k"))
    tiled = tiled.join(small(sides.filter("k > 1"), 12), "hub", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    tiled = stored(tiled.select("a", "b", F.xxhash64("hub", F.pmod(F.xxhash64("a"), "k"), F.pmod(F.xxhash64("b", F.lit(1)), "k")).alias("tile")), "tiles")
    needed = tiled.select("tile", F.col("a").alias("node")).union(tiled.select("tile", F.col("b").alias("node"))).distinct()
    rows = one.select("node", F.col("best.row").alias("row")).join(needed.select("node").distinct(), "node", "left_semi")
    d = only(docs, "doc_id", "text")
    d = d.select(row_key(d).alias("row"), F.col("text").cast("string")).join(small(rows, 60), "row").dropDuplicates(["node"]).select("node", "text")
    grams = d.mapInArrow(_grams, "node bigint, grams binary")
    loaded = needed.join(grams, "node").select("tile", F.col("node").alias("a"), F.lit(0).cast("bigint").alias("b"), "grams")
    todo = loaded.union(tiled.select("tile", "a", "b", F.lit(None).cast("binary")))
    todo = todo.repartition(parts, "tile").sortWithinPartitions("tile")
    return todo.mapInArrow(_verify(threshold), "a bigint, b bigint, jaccard double")


def _grouped(one: DataFrame, pairs: DataFrame) -> DataFrame:
    """one's nodes that have a link or several rows, with their component, itself if it's alone."""
    groups = components(pairs.select("a", "b")).withColumnRenamed("node", "__node")
    joined = one.join(groups, one["node"] == groups["__node"], "left").filter("n > 1 or component is not null")
    return joined.withColumn("component", F.coalesce("component", "node"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): each document that has a link, that is another row whose n-gram set has at least this Jaccard similarity with its own.

    links counts all of them, exact copies and near ones; class_id is the least doc_id among
    those that links connect, so a class is read off by it. Texts that are null or without a
    word link to nothing; one of fewer than NGRAM words is a single n-gram. Rows of null doc_id
    take no part. A doc_id on several texts has a row for each n-gram set; repeated rows count
    once. An empty table gives no rows.
    """
    signed = stored(signatures(only(docs, "doc_id", "text").filter("doc_id is not null"), threshold).dropDuplicates(["doc_id", "sid"]), "signed")
    one = distinct_sets(signed)
    pairs = stored(set_pairs(docs, one, threshold).select("a", "b"), "links")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(one.select(F.col("node").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    grouped = stored(_grouped(one, pairs).select("sid", "node", "n", "best", "component"), "grouped")
    least = grouped.groupBy("component").agg(F.min("best.doc_id").alias("class_id"))
    info = grouped.join(least, "component").join(others, F.col("node") == F.col("a"), "left")
    info = stored(info.select("sid", "n", "class_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links")), "classes")
    members = signed.select("doc_id", "sid", F.encode("row", "UTF-8").alias("spread"))
    return spread_join(members, info, "sid", "n", "spread").select("doc_id", "class_id", "links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents without those of which a near or exact copy stays: of each connected group the row of least doc_id stays (then least row key).

    A null doc_id counts as the greatest. Texts that are null or without a word all stay. Of rows
    that repeat in doc_id and text one stays. The result has the columns of documents; an empty table gives an empty one.
    """
    docs = only(docs, *DOCUMENTS)
    signed = stored(signatures(docs, threshold), "signed")
    one = distinct_sets(signed)
    grouped = stored(_grouped(one, set_pairs(docs, one, threshold)).select("sid", "n", "best", "component"), "grouped")
    stay = grouped.groupBy("component").agg(F.min("best").alias("stay"))
    info = stored(grouped.join(stay, "component").select("sid", "n", F.col("stay.row").alias("stay")), "staying")
    members = signed.groupBy("sid", "row").agg(F.count(F.lit(1)).alias("times")).withColumn("spread", F.encode("row", "UTF-8"))
    fate = spread_join(members, info, "sid", "n", "spread").select(F.col("row").alias("__row"), (F.col("row") != F.col("stay")).alias("lost"), "times")
    fate = stored(fate.filter("lost or times > 1"), "fate")
    keyed = docs.withColumn("__row", row_key(docs)).join(small(fate, 60), "__row", "left")
    single = keyed.filter("lost is null")
    repeated = keyed.filter("lost = false").dropDuplicates(["__row"])
    return single.union(repeated).select(*DOCUMENTS)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with a near or exact copy: its class and the number of its links."""
    return classes(documents(spark, sf_dir))
