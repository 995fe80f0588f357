"""Substring deduplication by MinHash banding of paragraphs.

Passages are pasted anywhere, so paragraphs are cut where the text itself says: LENGTH
words from each anchor, an anchor being the word whose n-gram hash is least among WINDOW
neighbours. Anchors lie at most WINDOW words apart and WINDOW is no more than LENGTH, so
paragraphs cover the text but for its two ends and runs of one repeated n-gram, and any
passage of LENGTH + WINDOW - 1 = 39 words that two texts share has a paragraph that both
of them cut alike. Exact repeats are counted by hash, so that each paragraph is
banded once. MinHash bands bring near copies together, but for neighbours that overlap in
the one text where all of a band's members first stand; colliding paragraphs are verified by the exact
Jaccard similarity of their shingles, and connected components of verified pairs, each
with all its exact repeats, keep their first occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm._shared import documents, only, stored
from sylva.llm._tokens import _NGRAM, mix, over, ngrams, slices, tokenize
from sylva.llm.components import components
from sylva.llm.jaccard_join import _groups

LENGTH, WINDOW, SHINGLE = 20, 20, 4
THRESHOLD, RECALL = 0.6, 0.93
_SHINGLES = LENGTH - SHINGLE + 1
#: Members of a group up to which all its pairs are compared at once.
_FEW = 12


def tune(threshold: float, recall: float, most: int = 4) -> tuple[int, int]:
    """(bands, rows): the most selective banding, within `most` bands, that finds pairs at the threshold with the recall."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most:
            return bands, rows
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1


BANDS, ROWS = tune(THRESHOLD, RECALL)
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 211) | np.uint64(1)


def _slide(x: np.ndarray, width: int, pick: np.ufunc, empty: int) -> np.ndarray:
    """out[i] = pick over x[i : i + width], by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        shifted = np.full_like(out, empty)
        shifted[: len(out) - step] = out[step:]
        out, have = pick(out, shifted), have + step
    return out


def anchors(grams: np.ndarray, offs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices into grams of the paragraphs' first words. offs: each text's grams; size: its words."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    valid = np.maximum(size - LENGTH + 1, 0)
    place = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    room = np.repeat(valid, np.diff(offs))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(place < room, grams, top)
    least = np.where(place + WINDOW <= room, _slide(h, WINDOW, np.minimum, top), np.uint64(0))
    back = _slide(least[::-1], WINDOW, np.maximum, 0)[::-1]
    few = np.repeat(over(np.minimum, h, offs, top), np.diff(offs))
    chosen = (place < room) & np.where(room < WINDOW, h == few, h == back)
    again = np.concatenate([[False], h[1:] == h[:-1]]) & (place > 0)
    return np.flatnonzero(chosen & ~again)


def _hashes(hashes: np.ndarray, grams: np.ndarray, at_word: np.ndarray, at_gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each paragraph's words, and its shingles."""
    total = np.zeros(len(at_word), np.uint64)
    for j in range(LENGTH):
        total = total * _NGRAM[7] + hashes[at_word + j] * _NGRAM[j % 7]
    return mix(total), grams[at_gram[:, None] + np.arange(_SHINGLES)]


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", 1 << 21):
            t = tokenize(b.column("text"))
            grams, first, offs = ngrams(t, SHINGLE)
            at = anchors(grams, offs, np.diff(t.offs))
            if not len(at):
                continue
            doc = np.searchsorted(offs, at, "right") - 1
            ph, shingles = _hashes(t.hash, grams, first[at], at)
            rows = [np.min(shingles * f, 1) for f in _FACTORS]
            keys = []
            for k in range(BANDS):
                key = np.full(len(at), k, np.uint64)
                for r in rows[k * ROWS : (k + 1) * ROWS]:
                    key = mix(key * _NGRAM[6] + r)
                keys.append(pa.array(key.view(np.int64)))
            yield pa.record_batch([b.column("doc_id").take(pa.array(doc)), pa.array((at - offs[doc]).astype(np.int32)), pa.array(ph.view(np.int64)), *keys], ["doc_id", "start", "ph", *(f"k{k}" for k in range(BANDS))])


def _shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the asked paragraphs, if this is the text that they were cut from."""
    for whole in batches:
        for b in slices(whole, "text", 1 << 21):
            t = tokenize(b.column("text"))
            grams, first, offs = ngrams(t, SHINGLE)
            asked = b.column("asked")
            doc = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            start, want = flat.field("start").to_numpy().astype(np.int64), flat.field("ph").to_numpy()
            fits = start + LENGTH <= np.diff(t.offs)[doc]
            doc, start, want = doc[fits], start[fits], want[fits]
            at = offs[:-1][doc] + start
            ph, shingles = _hashes(t.hash, grams, first[at], at)
            same = ph.view(np.int64) == want
            if same.any():
                yield pa.record_batch({"ph": pa.array(want[same]), "shingles": pa.array([x.tobytes() for x in (shingles[same] >> np.uint64(32)).astype(np.uint32)], pa.binary())})


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of sorted shingles, repeats counted once."""
    new_a, new_b = (np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], 1) for x in (a, b))
    both = ((a[:, :, None] == b[:, None, :]).any(2) & new_a).sum(1)
    return both / (new_a.sum(1) + new_b.sum(1) - both)


def _connecting(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of alike rows of sorted shingles that connect all rows that alike ones connect.

    Alike rows share THRESHOLD of the shingles of either, so one of the rarest 1 - THRESHOLD of both (and one more);
    rows are compared only under these, and no more under a shingle whose holders are connected already.
    """
    n = len(own)
    words, code = np.unique(own, return_inverse=True)
    code = code.reshape(n, -1)
    new = np.concatenate([np.ones((n, 1), bool), own[:, 1:] != own[:, :-1]], 1)
    distinct = new.sum(1)
    rank = np.where(new, np.bincount(code[new], minlength=len(words))[code] * len(words) + code, np.iinfo(np.int64).max)
    rare = np.take_along_axis(code, np.argsort(rank, 1), 1)
    holder, at = np.nonzero(np.arange(code.shape[1]) <= (distinct - np.ceil(THRESHOLD * distinct - 1e-9))[:, None])
    word = rare[holder, at]
    several = np.bincount(word, minlength=len(words))[word] > 1
    holder, word = holder[several], word[several]
    of_row = np.searchsorted(holder, np.arange(n + 1))
    order = np.argsort(word, kind="stable")
    by_word, bound = holder[order], np.searchsorted(word[order], np.arange(len(words) + 1))
    closed, marked = np.zeros(len(words), bool), np.zeros(len(words), bool)
    group, members = np.arange(n), {}
    left, right = [], []
    for i in np.unique(holder):
        met = []
        for c in word[of_row[i] : of_row[i + 1]]:
            if not closed[c]:
                k = by_word[bound[c] : bound[c + 1]]
                other = k[group[k] != group[i]]
                closed[c] = not len(other)
                met.append(other[other > i])
        k = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
        if not len(k):
            continue
        marked[code[i]] = True
        both = (marked[code[k]] & new[k]).sum(1)
        marked[code[i]] = False
        k = k[both / (distinct[i] + distinct[k] - both) >= THRESHOLD]
        _, first = np.unique(group[k], return_index=True)
        for j in k[first]:
            left.append(i)
            right.append(j)
            less, more = sorted((group[i], group[j]), key=lambda g: len(members.get(g, (g,))))
            moved = members.pop(less, [less])
            group[moved] = more
            members.setdefault(more, [more]).extend(moved)
    return np.array(left, np.int64), np.array(right, np.int64)


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified pairs; of a large group those that first connect its members."""
    for t in _groups(batches, "key"):
        key, ph = t.column("key").to_numpy(), t.column("ph").to_numpy()
        shingles = np.sort(np.frombuffer(b"".join(t.column("shingles").to_pylist()), np.uint32).reshape(-1, _SHINGLES), 1)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        left, right = [], []
        for n in np.unique(size[(size > 1) & (size <= _FEW)]):
            i, j = np.triu_indices(n, 1)
            at = starts[size == n]
            for some in np.array_split(at, len(at) * len(i) // 4096 + 1):
                x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = _alike(shingles[x], shingles[y]) >= THRESHOLD
                left.append(ph[x[ok]])
                right.append(ph[y[ok]])
        for s, n in zip(starts[size > _FEW], size[size > _FEW], strict=True):
            x, y = _connecting(shingles[s : s + n])
            left.append(ph[s + x])
            right.append(ph[s + y])
        if left:
            yield pa.record_batch({"a": pa.array(np.concatenate(left), pa.int64()), "b": pa.array(np.concatenate(right), pa.int64())})


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, words, kept_doc_ids): spans of words that repeat, exactly or nearly, an earlier passage.

    Of a cluster's occurrences that of least doc_id and start stays; kept_doc_ids lists the
    documents where what a span repeats is kept, its own among them if it repeats itself. A
    span joins whole paragraphs that repeat without a gap between them, so up to WINDOW - 1 words of
    a passage may stand out at either end, and around words that a near copy has changed. Overlapping spans are merged. Null and empty texts, texts of under LENGTH words and rows
    of null doc_id have no spans. Repeated rows count once.
    """
    spark = docs.sparkSession
    d = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    names = [f"k{k}" for k in range(BANDS)]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = d.mapInArrow(_cut, "doc_id bigint, start int, ph bigint, " + ", ".join(f"{n} bigint" for n in names))
    # the keys of a hash are all the same, and min has one slot in a partial sum where first has two
    each = cut.groupBy("ph").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"), *(F.min(n).alias(n) for n in names))
    each = stored(each.select("ph", "first", (F.col("n") > 1).alias("again"), *names), "paragraphs")

    group = Window.partitionBy("key")
    keyed = each.select("ph", "first.doc_id", "first.start", F.explode(F.array(*names)).alias("key"))
    apart = (F.min("doc_id").over(group) < F.max("doc_id").over(group)) | (F.max("start").over(group) - F.min("start").over(group) >= LENGTH)
    near = stored(keyed.withColumn("apart", apart).filter("apart").drop("apart"), "colliding")

    asked = near.select("ph", "doc_id", "start").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "ph")).alias("asked"))
    asked = stored(asked, "asked")
    shingles = d.join(asked, "doc_id").select("text", "asked").mapInArrow(_shingled, "ph bigint, shingles binary").dropDuplicates(["ph"])
    met = near.select("key", "ph").join(shingles, "ph").repartition(parts, "key").sortWithinPartitions("key", "ph")
    edges = met.mapInArrow(_linked, "a bigint, b bigint")

    linked = stored(components(edges), "components")
    members = each.join(linked, each["ph"] == linked["node"], "left").filter("again or node is not null").select("ph", "first", F.coalesce("component", "ph").alias("c"))
    best = members.groupBy("c").agg(F.min("first").alias("kept"))
    kept = stored(members.join(best, "c").select("ph", F.col("kept.doc_id").alias("kept"), F.col("kept.start").alias("kept_start")), "kept")
    again = d.mapInArrow(_cut, "doc_id bigint, start int, ph bigint, " + ", ".join(f"{n} bigint" for n in names)).select("doc_id", "start", "ph")
    lost = again.join(kept, "ph").filter(f"doc_id <> kept or abs(start - kept_start) >= {LENGTH}").select("doc_id", "start", "kept")
    by_doc = Window.partitionBy("doc_id").orderBy("start")
    fresh = F.col("start") > F.coalesce(F.max(F.col("start") + LENGTH).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = lost.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(by_doc))
    spans = spans.groupBy("doc_id", "span").agg(F.min("start").alias("start"), (F.max("start") + LENGTH).alias("end"), F.sort_array(F.collect_set("kept")).alias("kept_doc_ids"))
    return spans.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("words"), "kept_doc_ids")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
