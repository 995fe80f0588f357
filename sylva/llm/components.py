"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm._shared import stored


#: Edges up to which one task finds the components; more are spread over the cluster, with the same result.
ONE_TASK = 1 << 20


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least node of each node's component, by hooking roots and halving paths."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, root = code[: len(u)], code[len(u) :], np.arange(len(nodes))
    while not np.array_equal(root[x], root[y]):
        a, b = root[x], root[y]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    yield pa.record_batch([pa.array(nodes, t.schema.field("u").type), pa.array(nodes[root], t.schema.field("u").type)], ["node", "component"])


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges (a, b), some that connect the same nodes: what many pairs of one group shrink to before any shuffle."""
    held, n = [], 0

    def thin() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        one = list(_joined(pa.RecordBatch.from_arrays([t.column("a").combine_chunks(), t.column("b").combine_chunks()], ["u", "v"]) for _ in (0,)))[0]
        tree = pa.compute.not_equal(one.column("node"), one.column("component"))
        # the very schema of what came in, nullability too: the next batches join this one in a table
        return pa.record_batch([one.column(c).filter(tree).cast(f.type) for c, f in zip(("component", "node"), t.schema, strict=True)], schema=t.schema)

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= ONE_TASK:
            held = [thin()]
            n = held[0].num_rows
            if n >= ONE_TASK // 2:
                yield held.pop()
                n = 0
    if held:
        yield thin()


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) hang on to its least neighbour."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    hung = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one sortable type -> (node, component): the least node that it reaches.

    Nulls and loops are dropped; repeated edges don't matter; no edges give no rows.
    Every step is written to the shared folder, so lineage stays short. It ends when a
    step changes nothing, after O(log^2 n) steps.
    """
    kind = dict(edges.dtypes)["a"]
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b").mapInArrow(forest, f"a {kind}, b {kind}")
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = stored(stars, "edges")
    if stars.count() <= ONE_TASK:
        return stars.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    seen = None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == seen:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = tuple(now)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = _star(both, True)
        stars = stored(_star(grown, False), "stars")
