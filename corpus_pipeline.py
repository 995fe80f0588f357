"""The corpus pipeline: each stage's result is written as Parquet and reread as the next one's documents.

Rows whose text is null, empty or without a word are kept by all stages and come out as pieces of length 0 without a
bin. Of rows that repeat, or that are near copies, the row of least doc_id stays, a null doc_id being the greatest;
ties go by the row's hash. Texts are taken whole, however long. Of columns other than those of documents none comes
out. Empty tables give no rows; without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from sylva.llm._shared import DOCUMENTS, documents, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over many sites."""
    return line_dedup.clean_lines(docs).select(*DOCUMENTS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in bins."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", clean_lines), ("ngram_jaccard_join", keep_one), ("benchmark_decontamination", drop_leaks), ("best_fit_packing", pack)]
#: Learned weights and latent directions are beyond SQL; tests/llm/test_ops.py holds the run against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
