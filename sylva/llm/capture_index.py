"""External merge of a capture index: runs sorted where they lie, merged by loser trees.

Each task sorts its captures by URL key and time into a run, cut at common bounds, and
sends each piece as one row. A task of the merge holds the pieces of one range from all
runs and merges them with a loser tree: of k heads the least is found by replaying one
path. Bounds are whole sort keys, so captures of one URL may lie in many ranges, and
ranges stay even; what a history carries from one into the next is a row a range.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm._shared import only, stored
from sylva.llm._urls import SQL_SORT_KEY, sort_key

#: Captures in a run at most, and in a range about; keys drawn for a bound, which only serve to keep ranges even.
RUN, RANGE, DRAWN = 1 << 19, 1 << 18, 64
_KEY = ["urlkey", "ts", "page_id", "digest"]
_LEAST = -(1 << 63)
_RECORD = "urlkey string, ts bigint, page_id bigint, digest string, length bigint"


class LoserTree:
    """A tournament over the heads of sorted runs. Inner nodes keep their match's loser, tree[0] the winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.tree = runs, [0] * len(runs), [-1] * len(runs)
        for i in range(len(runs) - 1, -1, -1):
            self._replay(i)

    def _precedes(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0
        x, y = self.at[a], self.at[b]
        if x == len(self.runs[a]) or y == len(self.runs[b]):
            return x < len(self.runs[a])
        return (self.runs[a][x], a) < (self.runs[b][y], b)

    def _replay(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            if self._precedes(self.tree[node], i):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def merge(self) -> Iterator[tuple[int, int, int]]:
        """(run, from, to) in merged order: the winner gives all that precede the next best head."""
        while self.runs and self.at[w := self.tree[0]] < len(self.runs[w]):
            node, rival = (w + len(self.runs)) // 2, -1
            while node:
                if rival < 0 or self._precedes(self.tree[node], rival):
                    rival = self.tree[node]
                node //= 2
            lo, own = self.at[w], self.runs[w]
            if rival < 0 or self.at[rival] == len(self.runs[rival]):
                hi = len(own)
            else:
                cut = bisect.bisect_right if w < rival else bisect.bisect_left
                hi = max(lo + 1, cut(own, self.runs[rival][self.at[rival]], lo))
            yield w, lo, hi
            self.at[w] = hi
            self._replay(w)


def _keys(t: pa.Table) -> list[tuple]:
    return list(zip(*(t.column(c).to_pylist() for c in _KEY), strict=True))


def _pieces(bounds_of, run_rows: int):
    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in _KEY])
        keys = _keys(t)
        at = [0, *(bisect.bisect_left(keys, b) for b in bounds_of()), len(keys)]
        for r, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if hi > lo:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t.slice(lo, hi - lo).combine_chunks())
                yield pa.record_batch({"range": pa.array([r], pa.int32()), "piece": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= run_rows:
                yield from cut(held)
                held, n = [], 0
        if n:
            yield from cut(held)

    return run


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges lie together in the batches, a piece a row."""
    held: list[pa.Table] = []
    now = None

    def flush() -> Iterator[pa.RecordBatch]:
        runs = [_keys(t) for t in held]
        base = [0]
        for x in runs:
            base.append(base[-1] + len(x))
        order, nth, previous = [], [], []
        key, n, last = None, 0, None
        for r, lo, hi in LoserTree(runs).merge():
            order.extend(range(base[r] + lo, base[r] + hi))
            for k in runs[r][lo:hi]:
                n, last = (n + 1, last) if k[0] == key else (1, None)
                nth.append(n)
                previous.append(last)
                key, last = k[0], k[3]
        t = pa.concat_tables(held).take(pa.array(order))
        for c, x in (("nth", pa.array(nth, pa.int64())), ("previous", pa.array(previous, pa.string())), ("pos", pa.array(range(len(order)), pa.int64())), ("range", pa.array([now] * len(order), pa.int32()))):
            t = t.append_column(c, x)
        yield from t.combine_chunks().to_batches(max_chunksize=1 << 16)

    for b in batches:
        for r, piece in zip(b.column("range").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if r != now and held:
                yield from flush()
                held = []
            now = r
            held.append(pa.ipc.open_stream(piece).read_all())
    if held:
        yield from flush()


def histories(pages: DataFrame, time: str | None = None, run_rows: int = RUN, range_rows: int = RANGE) -> DataFrame:
    """(seq, urlkey, ts, page_id, digest, length, capture, changed): all captures in order of URL key, time, page_id, digest.

    seq counts captures from 0 over all, capture those of a URL key from 1; changed tells that
    it is the first or that its digest differs from the one before. time names a bigint column;
    without one, page_id stands for the order of the crawl. Null URLs share the key of an empty one; null
    times and page_ids come first and stay null; a null page has a null digest and length.
    Repeated rows are captures each. An empty table gives no rows.
    """
    spark = pages.sparkSession
    p = only(pages, "page_id", "url", "html", *([time] if time else []))
    index = p.select(
        sort_key(F.col("url")).alias("urlkey"),
        F.coalesce(F.col(time or "page_id").cast("bigint"), F.lit(_LEAST)).alias("ts"),
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(_LEAST)).alias("page_id"),
        F.coalesce(F.md5("html"), F.lit("")).alias("digest"),
        F.length("html").cast("bigint").alias("length"),
    )
    index = stored(index, "captures")
    rows = index.count()
    parts = max(1, min(rows, max(-(-rows // range_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    drawn = sorted(tuple(r) for r in index.select(*_KEY).orderBy(F.xxhash64(*_KEY)).limit(parts * DRAWN).collect())
    bounds = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []
    shared = spark.sparkContext.broadcast(bounds)
    pieces = index.mapInArrow(_pieces(lambda: shared.value, run_rows), "range int, piece binary")
    merged = pieces.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_merged, f"{_RECORD}, nth bigint, previous string, pos bigint, range int")
    merged = stored(merged, "merged")

    ends = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min_by("urlkey", "pos").alias("first"), F.max_by(F.struct("urlkey", "nth", "digest"), "pos").alias("last"))
    carried, offset, key, nth, digest = [], 0, None, 0, None
    for r in sorted(ends.collect(), key=lambda r: r["range"]):  # a row a range
        carried.append((r["range"], offset, key, nth, digest))
        last = r["last"]
        nth = last["nth"] + (nth if r["first"] == key == last["urlkey"] else 0)
        offset, key, digest = offset + r["n"], last["urlkey"], last["digest"]
    carry = spark.createDataFrame(carried, "range int, offset bigint, key string, had bigint, was string")
    joined = merged.join(F.broadcast(carry), "range")
    goes_on = (F.col("urlkey") == F.col("key")) & (F.col("nth") == F.col("pos") + 1)
    before = F.when(goes_on & (F.col("nth") == 1), F.col("was")).otherwise(F.col("previous"))
    none = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return joined.select(
        (F.col("offset") + F.col("pos")).alias("seq"),
        "urlkey",
        none("ts").alias("ts"),
        none("page_id").alias("page_id"),
        F.when(F.col("digest") != "", F.col("digest")).alias("digest"),
        "length",
        (F.col("nth") + F.when(goes_on, F.col("had")).otherwise(F.lit(0))).alias("capture"),
        F.coalesce(before != F.col("digest"), F.lit(True)).alias("changed"),
    )


def op4_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = f"""
WITH c AS (SELECT {SQL_SORT_KEY} AS urlkey, page_id, md5(html) AS digest, length(html) AS length FROM pages)
SELECT row_number() OVER (ORDER BY urlkey, page_id, digest) - 1 AS seq, urlkey, page_id AS ts, page_id, digest, length,
  row_number() OVER w AS capture, lag(digest) OVER w IS DISTINCT FROM digest OR row_number() OVER w = 1 AS changed
FROM c WINDOW w AS (PARTITION BY urlkey ORDER BY page_id, digest)
"""
