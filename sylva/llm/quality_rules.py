"""Quality rules as a decision list, learned by sequential covering.

Rules against low quality are found one after the other on labelled statistics: a
conjunction of thresholds grows by information gain on two thirds of the rows, then
loses conditions as long as that helps on the other third; the rows that it covers are
taken out and the next one is sought. The list becomes one conditional expression over
columns, first match first, so that scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm._shared import documents, only

#: Most labelled documents that the list is learned from: those of least hash.
SAMPLE = 50_000
CUTS, CONDITIONS, RULES = 64, 4, 12
#: Least share of low quality among what a rule covers, in either part; least rows that it covers.
PRECISION, COVER = 0.8, 4


def statistics(text: Column) -> dict[str, Column]:
    """Shares and means of a text, 0 for an empty one."""
    chars, words = F.greatest(F.length(text), F.lit(1)), F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))
    lines, split = F.split(text, "\n"), F.split(text, r"\s+")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "words": words.cast("double"),
        "word_length": chars / words,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count("[0-9]") / chars,
        "symbols": count(r"""[^\p{L}\p{N}\s.,;:?!'"()-]""") / chars,
        "shouts": count("[!?]{2,}") / words,
        "stops": count(r"[.!?](?:\s|$)") / words,
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "distinct_words": F.size(F.array_distinct(split)) / words,
    }


@dataclass
class Rule:
    """conditions: (statistic, '>' or '<=', threshold), all of which must hold."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, cut in self.conditions:
            out &= x[name] > cut if op == ">" else x[name] <= cut
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.conditions:
            out = out & (F.col(name) > cut if op == ">" else F.col(name) <= cut)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {cut:.6g}" for n, op, cut in self.conditions)


def _grow(x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    rule, inside = Rule(), np.ones(len(low), bool)
    while len(rule.conditions) < CONDITIONS:
        p, n = int((inside & low).sum()), int((inside & ~low).sum())
        if not n or not p:
            break
        best, chosen = 0.0, None
        for name, v in x.items():
            own = v[inside]
            for cut in np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 2)[1:-1])):
                above = own > cut
                for op, some in ((">", above), ("<=", ~above)):
                    p1 = int(low[inside][some].sum())
                    n1 = int(some.sum()) - p1
                    if p1 >= COVER:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best + 1e-9:
                            best, chosen = gain, (name, op, float(cut))
        if chosen is None:
            break
        rule.conditions.append(chosen)
        inside = rule.covers(x)
    return rule


def _worth(rule: Rule, x: dict[str, np.ndarray], low: np.ndarray) -> tuple[float, int]:
    inside = rule.covers(x)
    p, n = int((inside & low).sum()), int((inside & ~low).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 0) -> list[Rule]:
    """The list, for these statistics and labels. No rows of either class: no rules."""
    part = np.random.default_rng(seed).permutation(len(low)) % 3
    left, rules = np.ones(len(low), bool), []
    while len(rules) < RULES:
        grow, prune = left & (part > 0), left & (part == 0)
        if low[grow].sum() < COVER or low[grow].all():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, low[grow])
        if not rule.conditions:
            break
        held, held_low = {k: v[prune] for k, v in x.items()}, low[prune]
        while len(rule.conditions) > 1:
            tries = [Rule(rule.conditions[:i] + rule.conditions[i + 1 :]) for i in range(len(rule.conditions))]
            best = max(tries, key=lambda r: _worth(r, held, held_low))
            if _worth(best, held, held_low)[0] < _worth(rule, held, held_low)[0]:
                break
            rule = best
        inside = rule.covers(x) & left
        p, all_in = int((inside & low).sum()), int(inside.sum())
        tested = rule.covers(held)
        if all_in < COVER or p < PRECISION * all_in or (tested.any() and held_low[tested].mean() < PRECISION):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled documents, chosen by hash of doc_id. Null labels are left
    out; a document labelled both ways counts as good; of repeated rows one is used."""
    lab = only(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    lab = lab.withColumn("h", F.xxhash64("doc_id", F.lit(13))).orderBy("h").limit(sample)
    d = only(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(lab), "doc_id").dropDuplicates(["doc_id", "text"])
    stats = statistics(F.col("text").cast("string"))
    got = d.select("h", "quality", *(c.alias(n) for n, c in stats.items())).toArrow().sort_by([("h", "ascending"), ("words", "ascending"), ("word_length", "ascending")])
    return learn({n: got.column(n).to_numpy() for n in stats}, got.column("quality").to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs' columns doc_id and text, with the statistics, `rule` (which one, from 1, decides; 0: none) and `keep`.

    Null texts and texts without a word are not judged: rule 0, kept. Repeated rows are each judged.
    """
    d = only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    stats = statistics(F.coalesce("text", F.lit("")))
    d = d.select("doc_id", "text", *(c.alias(n) for n, c in stats.items()))
    chosen = F.when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), 0)
    for k, rule in enumerate(rules, 1):
        chosen = chosen.when(rule.column(), k)
    return d.withColumn("rule", chosen.otherwise(0)).withColumn("keep", F.col("rule") == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its verdict and the rule that gave it."""
    docs = documents(spark, sf_dir)
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "rule", "keep")
