"""URL filters: allow and block entries in a trie of reversed host labels and path segments.

An entry `example.org` holds for the host and all below it, `example.org/a/b` for that
host's paths from /a/b on. The longest entry that a URL meets decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm._shared import BROADCAST_BYTES, BROADCAST_ROWS, only
from sylva.llm._urls import SQL_PARTS, parts

#: The list of the query, which fits the given pages: (entry, verdict).
RULES = [
    ("spam-farm.example.org", "block"),
    ("spam-farm.example.org/en/about", "allow"),
    ("example.net", "block"),
    ("m.ththth.example.net", "allow"),
    ("blog.ththan.example.net/en", "allow"),
    ("tiontion.example.com", "block"),
    ("blog.tiontion.example.com", "allow"),
    ("blog.tiontion.example.com/fr", "block"),
    ("therha.example.com/de", "block"),
]


class Trie:
    """Nested dictionaries of parts; a node's verdict and entry lie under the empty part."""

    def __init__(self, rules: Iterable[tuple[list[str], str, str]]):
        self.root: dict = {}
        for path, entry, verdict in rules:
            node = self.root
            for p in path:
                node = node.setdefault(p, {})
            if node.get("", ("", ""))[0] != "block":  # of an entry listed both ways the block holds
                node[""] = (verdict, entry)

    def find(self, path: list[str]) -> tuple[str, str] | None:
        node, best = self.root, None
        for p in path:
            node = node.get(p)
            if node is None:
                return best
            best = node.get("", best)
        return best


def _entries(rules: DataFrame) -> DataFrame:
    """(path, entry, verdict): one row for each path, of one listed both ways the block. A scheme before an entry says nothing."""
    r = only(rules, "entry", "verdict").filter("trim(entry) <> '' and verdict in ('allow', 'block')")
    bare = F.regexp_replace(F.trim("entry"), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    r = r.select(parts(F.concat(F.lit("//"), bare)).alias("path"), F.trim("entry").alias("entry"), "verdict")
    # an entry without path ends with its host
    r = r.withColumn("path", F.when(F.element_at("path", -1) == "/", F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path")))
    return r.groupBy("path").agg(F.max(F.struct("verdict", "entry")).alias("v")).select("path", "v.entry", "v.verdict")


def judge(pages: DataFrame, rules: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages' columns page_id and url, with `verdict` (allow, block or none) and the `entry` that decided.

    A list beyond most_rows or 32 MB isn't broadcast: URLs are then joined with it on each
    of their prefixes, with the same result. Null or hostless URLs meet no entry: none.
    Entries that are null, empty or of another verdict are left out; an empty list
    decides nothing; repeated pages are each judged.
    """
    p = only(pages, "page_id", "url")
    e = _entries(rules)
    rows, size = e.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("entry")), F.lit(0))).first()
    if rows <= most_rows and 8 * size <= BROADCAST_BYTES:
        shared = p.sparkSession.sparkContext.broadcast(Trie((r["path"], r["entry"], r["verdict"]) for r in e.toLocalIterator()))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            for b in batches:
                found = [trie.find(x) or ("none", None) for x in b.column("path").to_pylist()]
                yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "verdict": pa.array([x for x, _ in found], pa.string()), "entry": pa.array([x for _, x in found], pa.string())})

        kind = dict(p.dtypes)["page_id"]
        return p.withColumn("path", parts(F.col("url"))).mapInArrow(run, f"page_id {kind}, url string, verdict string, entry string")
    urls = p.select("url").filter("url is not null").distinct().withColumn("path", parts(F.col("url")))
    prefixes = urls.select("url", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    met = prefixes.join(e, "path").groupBy("url").agg(F.max_by(F.struct("verdict", "entry"), F.size("path")).alias("v"))
    return p.join(met, "url", "left").select("page_id", "url", F.coalesce("v.verdict", F.lit("none")).alias("verdict"), F.col("v.entry").alias("entry"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "entry string, verdict string"))


SQL = f"""
WITH rules AS (
  SELECT entry, verdict, CASE WHEN p[-1] = '/' THEN p[:-2] ELSE p END AS path FROM (
    SELECT entry, verdict, {SQL_PARTS} AS p FROM (SELECT *, '//' || entry AS url FROM (VALUES {", ".join(f"('{e}', '{v}')" for e, v in RULES)}) AS t(entry, verdict))
  )
), cut AS (
  SELECT page_id, url, {SQL_PARTS} AS p FROM pages
), met AS (
  SELECT page_id, url, arg_max(verdict, len(path)) AS verdict, arg_max(entry, len(path)) AS entry
  FROM cut JOIN rules ON p[1:len(path)] = path GROUP BY page_id, url
)
SELECT pages.page_id, pages.url, coalesce(verdict, 'none') AS verdict, entry FROM pages LEFT JOIN met USING (page_id)
"""
