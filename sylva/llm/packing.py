"""Best-fit packing of documents into bins of equal capacity by linear grouping.

Large pieces, sorted by length, are cut into groups of equal cardinality and rounded up
to the largest of their group; that leaves few sizes, for which a cutting-stock linear
programme over bin configurations is solved by column generation. Actual pieces take
the slots of the rounded ones, then small pieces are placed best-fit, longest first,
into the room that is left.

All of this needs the histogram of lengths alone, whose size the capacity bounds. It
yields intervals: pieces of ranks r0 to r1, in order of length, go to bins b0, b0 + 1
and so on, q to each. The cluster ranks the pieces and looks the intervals up.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm._shared import documents, only, stored, text_key

CAPACITY, GROUPS, SMALL = 2048, 24, 8
#: Pieces of one length, about, that a task ranks: a length of more is split by hash.
_ROWS = 1 << 20


def _best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        best[room] = best[room - 1]
        ok = np.flatnonzero(sizes <= room)
        gain = best[room - sizes[ok]] + value[ok]
        k = int(gain.argmax())
        if gain[k] > best[room] + 1e-12:
            best[room], last[room] = gain[k], ok[k]
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        pattern[last[room]] += 1
        room -= int(sizes[last[room]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, bins) that meet the demand exactly: the programme's solution rounded down, the rest packed first-fit, longest first."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(400):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = _best_pattern(dual, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        x, enter = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, pattern.astype(float))
        up = np.flatnonzero(enter > 1e-9)
        ratio = np.maximum(x[up], 0) / enter[up]
        basis[:, up[int(ratio.argmin())]] = pattern
    x = np.linalg.solve(basis, demand.astype(float))
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = np.rint(basis[:, j]).astype(int)
        used = pattern > 0
        n = int(min(max(0, np.floor(x[j] + 1e-9)), (left[used] // pattern[used]).min()))
        if n:
            out.append((pattern, n))
            left -= pattern * n
    while left.any():
        pattern, room = np.zeros(k, int), capacity
        for i in range(k):
            n = min(int(left[i]), room // int(sizes[i]))
            pattern[i], room = n, room - n * int(sizes[i])
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        out.append((pattern, n))
        left -= pattern * n
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (r0, r1, b0, q) and the number of bins, for pieces of these distinct lengths, given longest first."""
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    rows: list[tuple[int, int, int, int]] = []
    bins = 0
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def put(left: int, b: int, n: int) -> None:
        if n and left > 0:
            if left not in room:
                bisect.insort(order, left)
            room.setdefault(left, []).append((b, n))

    full = int(first[np.searchsorted(-lengths, -capacity, "right")])
    if full:
        rows.append((0, full, 0, 1))
        bins = full
    end = int(first[np.searchsorted(-lengths, -(capacity // SMALL), "left")])
    if end > full:
        cuts = sorted({full + (end - full) * g // groups for g in range(groups + 1)})
        sizes = lengths[np.searchsorted(first, cuts[:-1], "right") - 1]
        new = np.concatenate([[True], sizes[1:] != sizes[:-1]])
        at, sizes = np.array(cuts[:-1])[new], sizes[new]
        demand = np.diff(np.append(at, end))
        for pattern, n in configurations(sizes, demand, capacity):
            slots = []
            for i in np.flatnonzero(pattern):
                for _ in range(pattern[i]):
                    rows.append((int(at[i]), int(at[i]) + n, bins, 1))
                    slots.append(int(at[i]))
                    at[i] += n
            edges = {0, n}
            for s in slots:
                inside = first[np.searchsorted(first, s, "right") : np.searchsorted(first, s + n, "left")]
                edges.update((inside - s).tolist())
            edges = sorted(edges)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                held = sum(int(lengths[np.searchsorted(first, s + lo, "right") - 1]) for s in slots)
                put(capacity - held, bins + lo, hi - lo)
            bins += n
    for k in range(int(np.searchsorted(first, end, "left")), len(lengths)):
        size, r, c = int(lengths[k]), int(first[k]), int(counts[k])
        while c:
            i = bisect.bisect_left(order, size)
            if i == len(order):
                n = -(-c // (capacity // size))
                put(capacity, bins, n)
                bins += n
                continue
            left = order[i]
            b, n = room[left].pop()
            if not room[left]:
                del room[left]
                order.pop(i)
            q = min(left // size, c)
            used = min(n, c // q)
            rows.append((r, r + used * q, b, q))
            r, c = r + used * q, c - used * q
            put(left - q * size, b, used)
            put(left, b + used, n - used)
    return np.array(sorted(rows), np.int64).reshape(-1, 4), bins


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(bin_id, doc_id, piece, start, length, at): pieces of documents, counted in words, and their places in bins.

    A document longer than the capacity is cut into pieces of it and a rest. Null and empty
    texts have one piece of length 0 and no bin. Repeated rows are packed each; ties in
    length go by doc_id, then text. An empty table gives no rows.
    """
    d = only(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("t"), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("words"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("words") - 1) / capacity)).cast("int")))
    d = d.select("doc_id", "t", "words", piece.alias("piece")).withColumn("start", F.col("piece") * capacity)
    d = d.withColumn("length", F.least(F.lit(capacity), F.col("words") - F.col("start")))
    d = stored(d.drop("words"), "pieces")
    some = d.filter("length > 0")
    spark = d.sparkSession
    split = [(r[0], -(-r[1] // _ROWS)) for r in some.groupBy("length").count().collect()]  # as many as capacity allows
    split = F.broadcast(spark.createDataFrame(split, "length int, split long"))
    some = some.withColumn("length", F.col("length").cast("int")).join(split, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "t", "piece"), "split").cast("int")).drop("split")
    counted = some.groupBy("length", "bucket").count().toArrow()
    size, bucket, n = (counted.column(c).to_numpy() for c in ("length", "bucket", "count"))
    order = np.lexsort((bucket, -size))
    size, bucket, n = size[order], bucket[order], n[order]
    lengths, at = np.unique(-size, return_index=True)
    rows, _ = plan(-lengths.astype(np.int64), np.add.reduceat(n, at) if len(n) else n, capacity, groups)
    offsets = pa.table({"length": pa.array(size.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "before": pa.array(np.cumsum(n) - n, pa.int64())})
    offsets = F.broadcast(spark.createDataFrame(offsets, "length int, bucket int, before bigint"))  # a row for each length and for each _ROWS pieces
    ranked = some.join(offsets, ["length", "bucket"]).withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "t", "piece")) - 1)
    shared = spark.sparkContext.broadcast(rows)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for b in batches:
            r = b.column("r").to_numpy()
            i = np.searchsorted(rows[:, 0], r, "right") - 1
            yield b.append_column("bin_id", pa.array(rows[i, 2] + (r - rows[i, 0]) // rows[i, 3]))

    ranked = ranked.select(F.col("doc_id").cast("bigint"), "piece", "start", F.col("length").cast("int"), F.col("r").cast("bigint"))
    placed = ranked.mapInArrow(place, "doc_id bigint, piece int, start int, length int, r bigint, bin_id bigint")
    before = Window.partitionBy("bin_id").orderBy(F.col("r")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("bin_id", "doc_id", "piece", "start", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int").alias("at"))
    none = d.filter("length = 0").select(F.lit(None).cast("bigint").alias("bin_id"), F.col("doc_id").cast("bigint"), "piece", "start", F.col("length").cast("int"), F.lit(0).alias("at"))
    return placed.union(none)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
