"""Removal of boilerplate lines: lines that spread over many sites.

A HyperLogLog sketch of the sites is kept for each line hash; partial sketches merge in
the aggregation's shuffle. Lines whose estimate is near the threshold have their
distinct sites counted exactly, so the decision is exact where the sketch can't be
trusted. Copies of one document on many sites spread its lines, too, but aren't
boilerplate: a line has to reach the threshold again among those documents that consist
for the most part of other lines. One that does goes everywhere, also from documents
that hold nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm._shared import DOCUMENTS, documents, only, small, stored, text_digest

MIN_SITES, LG_K = 8, 10
#: A document vouches for its wide-spread lines if they make up at most this share of its characters.
PART = 0.5


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h): those of lines (h, site) that have at least min_sites distinct sites. A null site is none."""
    lines = lines.filter("site is not null").select("h", "site")
    margin = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    wide = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    wide = stored(wide.filter(F.col("sites") >= min_sites - margin), "spread")
    near = wide.filter(F.col("sites") <= min_sites + margin).select("h")
    exact = lines.join(small(near, 8), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites"))
    sure = wide.filter(F.col("sites") > min_sites + margin).select("h")
    return stored(sure.union(exact.filter(F.col("sites") >= min_sites).select("h")), "wide")


def _lines(docs: DataFrame) -> DataFrame:
    """(h, site, t, size, n): non-blank lines; t and size are their text's digest and length, n the line's."""
    whole = docs.select("text", F.col("source").cast("string").alias("site"), F.length("text").alias("size"), F.explode(F.split("text", "\n", -1)).alias("line"))
    whole = whole.filter("trim(line) <> ''")
    return whole.select(_hash(F.col("line")).alias("h"), "site", "size", F.length("line").alias("n"), "text")


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, part: float = PART) -> DataFrame:
    """All columns of documents, text without its boilerplate lines and n_chars to suit, and removed_lines.

    Boilerplate are trimmed, non-blank lines found on at least min_sites distinct sources, among all
    documents and again among those whose lines of that kind make up at most `part` of their
    characters. A null source is no site; such a row is cleaned all the same. Null and empty texts
    stay as they are; of a text of boilerplate alone its blank lines stay, or nothing; long texts
    are cleaned whole; repeated rows are each cleaned; an empty table gives an empty one.
    """
    docs = only(docs, *DOCUMENTS)
    lines = _lines(docs)
    wide = small(spread(lines.select("h", "site"), min_sites), 8)
    held = lines.join(wide, "h").groupBy(text_digest(F.col("text")).alias("t"), "site", "size", "h").agg(F.sum("n").alias("n"))
    held = stored(held, "held")
    share = held.groupBy("t", "site", "size").agg(F.sum("n").alias("lost"), F.collect_list("h").alias("all"))
    vouching = share.filter(F.col("lost") <= part * F.col("size")).select(F.explode("all").alias("h"), "site")
    gone = small(spread(vouching, min_sites), 8)
    gone = stored(held.join(gone, "h", "left_semi").groupBy("t").agg(F.collect_set("h").alias("__gone")), "gone").withColumnRenamed("t", "__t")
    joined = docs.withColumn("__t", text_digest(F.col("text"))).join(small(gone, 140), "__t", "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__gone"), _hash(x)))
    joined = joined.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept)).withColumn("__new", F.array_join("__kept", "\n"))
    return joined.select(
        "doc_id",
        F.coalesce("__new", "text").alias("text"),
        "lang",
        "source",
        F.when(F.col("__new").isNotNull(), F.length("__new").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
        F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).alias("removed_lines"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir)).select("doc_id", "text", "removed_lines")


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, length(text) AS size, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), wide AS (
  SELECT trim(l) AS line FROM lines WHERE trim(l) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), held AS (
  SELECT doc_id, source, size, line, length(l) AS n FROM lines JOIN wide ON trim(l) = line
), vouching AS (
  SELECT doc_id FROM held GROUP BY doc_id, size HAVING sum(n) <= {PART} * size
), gone AS (
  SELECT line FROM held SEMI JOIN vouching USING (doc_id) GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), judged AS (
  SELECT lines.*, gone.line IS NOT NULL AS bad FROM lines LEFT JOIN gone ON trim(l) = gone.line
), made AS (
  SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS new, count(*) FILTER (WHERE bad) AS n FROM judged GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN n > 0 THEN new ELSE text END AS text, CAST(coalesce(n, 0) AS INTEGER) AS removed_lines
FROM documents d LEFT JOIN made USING (doc_id)
"""
