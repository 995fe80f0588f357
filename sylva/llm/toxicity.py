"""Toxicity scores from a factorisation machine over hashed terms.

Besides a weight for each term the machine learns a short vector for each, and the dot
product of two terms' vectors weighs their meeting in one document, which a sum of
term weights can't. A document's terms are its distinct words, the beginnings of its
words (3 to 8 bytes) that are linked with the labels, each again for the second and the
third time that it occurs, and the order of magnitude of its length, so that a stem that
recurs in a short text is told from one that chance brings into a long one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from sylva.llm._shared import DOCUMENTS, documents, only, stored
from sylva.llm._tokens import binaries, mix, over, slices, tokenize

#: Hash buckets of words and of beginnings; lengths of these in bytes; times that one counts.
BITS, BEGIN, TIMES = 20, (3, 8), 3
#: Most labelled documents that the machine is fitted on: those of least hash.
SAMPLE = 20_000
FACTORS, EPOCHS, PATIENCE, BATCH = 8, 40, 4, 128
#: Least number of documents that a term must be in, whatever their total: rarer ones only recall single labels, wrong ones too.
MIN_DOCS = 5
#: Least chi-squared statistic of a beginning's link with the labels.
LINK = 15.0
#: Soft threshold on weights; on vectors, as a share of it; Adagrad's first sum of squares.
SHRINK, VECTOR_SHRINK, FIRST = 0.01, 0.1, 0.01
_BUCKETS = 1 << BITS
_TOP = _BUCKETS * (TIMES + 1)


@dataclass
class Machine:
    """ids: the terms that training kept, ascending; linear, factors: theirs, row by row."""

    ids: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The log-odds of documents, given as the distinct rows of each."""
        first = over(np.add, self.linear[rows], offs, 0)
        v = self.factors[rows]
        total, squares = over(np.add, v, offs, 0), over(np.add, v * v, offs, 0)
        return self.bias + first + 0.5 * (total**2 - squares).sum(1)

    def rows(self, terms: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of those terms that are kept, and the documents' offsets into them."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros_like(offs)
        at = np.minimum(np.searchsorted(self.ids, terms), len(self.ids) - 1)
        known = self.ids[at] == terms
        return at[known], np.concatenate([[0], np.cumsum(known)])[offs]


def useful(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, whether terms of its word, and of its beginning, are among ids."""
    word, begin = np.zeros(_BUCKETS, bool), np.zeros(_BUCKETS, bool)
    word[ids[ids < _BUCKETS]] = True
    begin[ids[(ids >= _BUCKETS) & (ids < _TOP)] % _BUCKETS] = True
    return word, begin


def terms_of(texts: pa.Array, word: np.ndarray | None = None, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text, ascending, and offsets. word, begin: the buckets that count (all, if None).
    A word's term is its bucket, a beginning's k-th occurrence k * _BUCKETS + bucket, a length's _TOP + its logarithm.
    A text without words has no terms."""
    t = tokenize(texts)
    doc = t.doc_of()
    bucket = (t.hash >> np.uint64(64 - BITS)).astype(np.int64)
    use = slice(None) if word is None else word[bucket]
    size = np.diff(t.offs)
    some = np.flatnonzero(size)
    found = [np.unique(doc[use] * 2 * _TOP + bucket[use]), some * 2 * _TOP + _TOP + np.log2(size[some]).astype(np.int64)]
    h = np.zeros(len(doc), np.uint64)
    at, starts = np.arange(len(doc)), t.start
    held = []
    for k in range(BEGIN[1]):
        longer = starts[at] + k < t.end[at]
        at = at[longer]
        h[at] = (h[at] + t.data[starts[at] + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        if k + 1 >= BEGIN[0]:
            b = (mix(h[at], k + 1) >> np.uint64(64 - BITS)).astype(np.int64)
            w = at
            if begin is not None:
                w, b = at[begin[b]], b[begin[b]]
            held.append(doc[w] * 2 * _TOP + b)
    pairs, times = np.unique(np.concatenate(held), return_counts=True)
    found += [pairs[times >= k] + k * _BUCKETS for k in range(1, TIMES + 1)]
    pairs = np.sort(np.concatenate(found))
    return pairs % (2 * _TOP), np.searchsorted(pairs, np.arange(len(t) + 1) * 2 * _TOP)


def linked(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Chi-squared statistics of terms that stand in so many toxic and clean documents of so many."""
    n = all_toxic + all_clean
    apart = (toxic * (all_clean - clean) - clean * (all_toxic - toxic)).astype(float)
    under = float(all_toxic) * all_clean * (toxic + clean) * (n - toxic - clean)
    return n * apart**2 / np.maximum(under, 1.0)


def fit(terms: list[np.ndarray], toxic: np.ndarray, seed: int = 0) -> Machine:
    """Adagrad on the logistic loss, classes weighted alike, with proximal steps that leave most terms at zero.
    A fifth of the documents, held out, says when to stop and sets the threshold. Terms of fewer than MIN_DOCS
    documents are left out. Without documents of both classes nothing is rejected."""
    df = np.zeros(_TOP + 64, np.int32)
    for x in terms:
        df[x] += 1
    kept = np.flatnonzero(df >= MIN_DOCS).astype(np.int32)
    del df
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept), np.float32), rng.normal(0, 0.01, (len(kept), FACTORS)).astype(np.float32)
    none = Machine(kept[:0], 0.0, w[:0], v[:0], np.inf)
    if len(np.unique(toxic)) < 2 or not len(kept):
        return none
    model = Machine(kept, 0.0, w, v, 0.0)
    docs = [model.rows(x, np.array([0, len(x)]))[0].astype(np.int32) for x in terms]
    held = np.zeros(len(docs), bool)
    for c in (0, 1):
        held[np.flatnonzero(toxic == c)[::5][1:]] = True
    train = np.flatnonzero(~held)
    judge = np.flatnonzero(held) if len(np.unique(toxic[held])) == 2 else np.arange(len(docs))
    judged = np.concatenate([docs[i] for i in judge]), np.concatenate([[0], np.cumsum([len(docs[i]) for i in judge])])
    share = toxic[train].mean()
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    bias, gb = 0.0, 1e-8
    gw, gv = np.full_like(w, FIRST), np.full_like(v, FIRST)
    best, waited = (np.inf, 0.0, w.copy(), v.copy()), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            some = train[at : at + BATCH]
            lens = np.array([len(docs[i]) for i in some])
            rows, offs = np.concatenate([docs[i] for i in some]), np.concatenate([[0], np.cumsum(lens)])
            x = v[rows]
            total = over(np.add, x, offs, 0)
            z = bias + over(np.add, w[rows], offs, 0) + 0.5 * (total**2 - over(np.add, x * x, offs, 0)).sum(1)
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[some]) * weight[some] / len(some)).astype(np.float32)
            each = np.repeat(err, lens)
            used, back = np.unique(rows, return_inverse=True)
            dw = np.bincount(back, each, len(used)).astype(np.float32)
            grad = each[:, None] * (np.repeat(total, lens, 0) - x)
            dv = np.stack([np.bincount(back, grad[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32)
            gw[used] += dw**2
            gv[used] += dv**2
            gb += float(err.sum()) ** 2
            step = 0.1 / np.sqrt(gw[used])
            moved = w[used] - step * dw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * SHRINK, 0)
            step = 0.1 / np.sqrt(gv[used])
            moved = v[used] - step * dv
            long = np.linalg.norm(moved, axis=1, keepdims=True)
            v[used] = moved * np.maximum(0, 1 - step.mean(1, keepdims=True) * SHRINK * VECTOR_SHRINK / np.maximum(long, 1e-12))
            bias -= 0.1 * float(err.sum()) / gb**0.5
        model.bias = bias
        z = model.score(*judged)
        loss = float((np.logaddexp(0, np.where(toxic[judge] == 1, -z, z)) * weight[judge]).mean())
        waited += 1
        if loss < best[0] * (1 - 1e-3):
            best, waited = (loss, bias, w.copy(), v.copy()), 0
        if waited >= PATIENCE:
            break
    _, bias, w, v = best
    live = (w != 0) | (np.abs(v).sum(1) > 0)
    model = Machine(kept, bias, w, v, 0.0)
    z = model.score(*judged)
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[judge][order])
    f = 1.25 * hits / (np.arange(len(order)) + 1 + 0.25 * toxic[judge].sum())  # F0.5: a clean document lost weighs more
    k = int(np.flatnonzero(f >= f.max() - 1e-12)[0])
    zs = z[order]
    threshold = float((zs[k] + zs[k + 1]) / 2) if k + 1 < len(zs) else float(zs[k])
    return Machine(kept[live], bias, w[live], v[live], threshold)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): in how many documents of the partition terms stand."""
    n = np.zeros((2, _TOP), np.int32)
    for whole in batches:
        for b in slices(whole, "text"):
            terms, offs = terms_of(b.column("text"))
            toxic = np.repeat(b.column("toxic").to_numpy(), np.diff(offs))
            for c in (0, 1):
                x, times = np.unique(terms[(toxic == c) & (terms < _TOP) & (terms >= _BUCKETS)], return_counts=True)
                n[c, x] += times.astype(np.int32)
    some = np.flatnonzero(n.any(0))
    for at in range(0, len(some), 1 << 16):
        x = some[at : at + (1 << 16)]
        yield pa.record_batch({"term": pa.array(x, pa.int64()), "toxic": pa.array(n[1, x]), "clean": pa.array(n[0, x])})


def _sample_terms(begin: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                terms, offs = terms_of(b.column("text"), None, begin)
                yield pa.record_batch({"h": b.column("h"), "toxic": b.column("toxic"), "terms": binaries(terms.astype(np.int32), offs)})

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` labelled documents, chosen by hash of doc_id. Labels that
    are null are left out; a document labelled both ways counts as toxic; of repeated rows one is used,
    of several texts of a doc_id the first in order."""
    lab = only(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    lab = lab.withColumn("h", F.xxhash64("doc_id", F.lit(11))).orderBy("h").limit(sample)
    d = only(docs, "doc_id", "text").join(F.broadcast(lab), "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min(F.col("text").cast("string")).alias("text"))
    d = stored(d, "labelled")
    total = {r[0]: r[1] for r in d.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return fit([], np.zeros(0, int))
    counted = d.select("toxic", "text").coalesce(4).mapInArrow(_counts, "term bigint, toxic int, clean int").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.filter(F.col("toxic") + F.col("clean") >= MIN_DOCS).toArrow()  # bounded by the buckets
    term, bad, good = (counted.column(c).to_numpy() for c in ("term", "toxic", "clean"))
    begin = np.zeros(_BUCKETS, bool)
    begin[term[linked(bad, good, total[1], total[0]) >= LINK] % _BUCKETS] = True
    shared = d.sparkSession.sparkContext.broadcast(begin)
    got = d.mapInArrow(lambda x: _sample_terms(shared.value)(x), "h bigint, toxic int, terms binary").toArrow()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    terms = got.column("terms")
    return fit([np.frombuffer(terms[int(i)].as_buffer(), np.int32) for i in order], got.column("toxic").to_numpy()[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs' columns doc_id, text and any others, with log-odds `toxic_score` and the verdict `toxic`, which
    replace columns of those names. A text that is null, empty or without known terms but its length is never
    rejected; texts are read whole, repeated rows are scored each, an empty table gives an empty one."""
    docs = docs.drop("toxic_score", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    out = StructType([*docs.schema.fields, StructField("toxic_score", DoubleType()), StructField("toxic", BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        word, begin = useful(m.ids)
        for whole in batches:
            for b in slices(whole, "text"):
                terms, offs = terms_of(b.column("text"), word, begin)
                known = over(np.maximum, terms < _TOP, offs, False)
                z = m.score(*m.rows(terms, offs)).astype(np.float64)
                yield pa.record_batch([*b.columns, pa.array(z), pa.array((z > m.threshold) & known)], [*b.schema.names, "toxic_score", "toxic"])

    return docs.mapInArrow(run, out)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, in their columns, that the machine doesn't reject; null and empty texts stay."""
    docs = only(docs, *DOCUMENTS)
    machine = train(docs, labels)
    return score(docs, machine).filter("not toxic").select(*DOCUMENTS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is scored; the result holds those that are rejected."""
    docs = only(documents(spark, sf_dir), "doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).filter("toxic").select("doc_id", "toxic_score", "toxic")
