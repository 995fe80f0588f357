"""Credentials in several parts: secrets joined with identifiers and endpoints nearby.

Secrets that prove themselves, weak ones, identifiers, endpoints and blank lines, which end
a scope, are looked for in a scan each, so that parts may overlap, as a secret within an
address does. Parts are joined by intervals: within a scope a secret reaches SPAN characters
to either side. A secret whose form is proof enough is reported by itself; a weak one,
any value that is called a token or password, only where an identifier or an endpoint
that isn't part of it completes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm._shared import documents, only, row_key, stored

SPAN = 400
#: Values are matched whole, a private key with its body if it ends.
STRONG = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=,: \t\r\n-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}"
WEAK = r"(?:[Tt]oken|TOKEN|[Ss]ecret(?:_access_key)?|SECRET(?:_ACCESS_KEY)?|[Pp]assw(?:or)?d|PASSW(?:OR)?D|[Pp]wd|[Aa]pi_?[Kk]ey|API_?KEY)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?[A-Za-z0-9+/_.~!@#$%^&*-]{8,}"
IDENTIFIER = r"AKIA[0-9A-Z]{16}|(?:[Uu]ser(?:name)?|USER(?:NAME)?|[Ll]ogin|[Cc]lient_id|CLIENT_ID|[Aa]ccount)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?[A-Za-z0-9._@-]{3,}|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,10}://[^ \t\n\"'<>]{3,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"
BLANK = r"\n[ \t\r]{0,8}\n"
_KINDS = [("strong", STRONG), ("weak", WEAK), ("identifier", IDENTIFIER), ("endpoint", ENDPOINT), ("blank", BLANK)]


def _scan(pattern: str) -> str:
    """What lies before a part, then the part; the last match is the rest of the text."""
    return rf"([\s\S]*?)({pattern}|\z)"


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, scope, start, length, kind, value) of texts that hold a secret; start counts characters from 0."""
    d = only(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    d = d.filter(F.col("text").rlike(f"{STRONG}|{WEAK}"))
    d = stored(d.withColumn("row", row_key(d)).dropDuplicates(["row"]), "secretive")
    past = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = []
    for kind, pattern in _KINDS:
        found = F.arrays_zip(F.regexp_extract_all("text", F.lit(_scan(pattern)), F.lit(0)).alias("all"), F.regexp_extract_all("text", F.lit(_scan(pattern)), F.lit(2)).alias("value"))
        m = d.select("doc_id", "row", F.posexplode(found).alias("i", "m")).select("doc_id", "row", "i", F.length("m.all").alias("n"), F.col("m.value").alias("value"))
        m = m.withColumn("length", F.length("value")).withColumn("start", (F.sum("n").over(past) - F.col("length")).cast("int"))
        each.append(m.filter("length > 0").select("doc_id", "row", "start", "length", F.lit(kind).alias("kind"), "value"))
    m = reduce(DataFrame.union, each)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("scope", F.sum(F.when(F.col("kind") == "blank", 1).otherwise(0)).over(before).cast("int"))
    return m.filter(~((F.col("kind") == "blank") | ((F.col("kind") == "weak") & F.col("value").rlike(STRONG)))).select("doc_id", "row", "scope", "start", "length", "kind", "value")


def link(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, scope, start, length, strength, fingerprint, identifiers, endpoints): each strong secret, and each weak one that is completed.

    identifiers and endpoints count the distinct values that start at most span
    characters before the secret does or after it ends, in its scope, and that don't lie within it. A weak
    secret that holds a strong one is reported as the strong one alone. fingerprint is the SHA-256
    of the whole part as it stands, never the part. Null, empty and secretless texts give no
    rows, nor does an empty table; texts are scanned whole, however long; of parts of one kind that
    overlap the first in the text counts, ties go by the order of the forms; rows that repeat in
    doc_id and text count once; a null doc_id is kept as such.
    """
    p = stored(parts(docs), "parts").withColumn("cell", F.floor(F.col("start") / span))
    secret = p.filter("kind in ('strong', 'weak')").select("doc_id", "row", "scope", "start", "length", "kind", "value", F.explode(F.sequence(F.col("cell") - 1, F.floor((F.col("start") + F.col("length")) / span) + 1)).alias("cell"))
    other = p.filter("kind in ('identifier', 'endpoint')").select("row", "scope", "cell", F.col("start").alias("at"), (F.col("start") + F.col("length")).alias("to"), F.col("kind").alias("part"), F.col("value").alias("with"))
    apart = (F.col("at") < F.col("start")) | (F.col("to") > F.col("start") + F.col("length"))
    near = secret.join(other, ["row", "scope", "cell"], "left").withColumn("with", F.when(F.col("at").between(F.col("start") - span, F.col("start") + F.col("length") + span) & apart, F.col("with")))
    count = lambda part: F.count_distinct(F.when(F.col("part") == part, F.col("with"))).cast("int").alias(f"{part}s")
    linked = near.groupBy("doc_id", "row", "scope", "start", "length", "kind", F.sha2("value", 256).alias("fingerprint")).agg(count("identifier"), count("endpoint"))
    return linked.filter("kind = 'strong' or identifiers + endpoints > 0").select("doc_id", "scope", "start", "length", F.col("kind").alias("strength"), "fingerprint", "identifiers", "endpoints")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PARTS = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, value, sum(length(whole)) OVER (PARTITION BY doc_id ORDER BY i) - length(value) AS start FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, {_sql(_scan(p))}, 0)) AS whole, unnest(regexp_extract_all(text, {_sql(_scan(p))}, 2)) AS value,
    unnest(generate_series(1, len(regexp_extract_all(text, {_sql(_scan(p))}, 0)))) AS i FROM d)"""
    for kind, p in _KINDS
)
SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, text FROM documents WHERE regexp_matches(text, {_sql(f"{STRONG}|{WEAK}")})
), m AS ({_PARTS}), p AS (
  SELECT doc_id, value, kind, start, sum(CASE WHEN kind = 'blank' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start RANGE UNBOUNDED PRECEDING) AS scope FROM m WHERE value <> ''
), s AS (
  SELECT * FROM p WHERE kind = 'strong' OR kind = 'weak' AND NOT regexp_matches(value, {_sql(STRONG)})
), near AS (
  SELECT s.doc_id, s.scope, s.start, length(s.value) AS length, s.kind AS strength, sha256(s.value) AS fingerprint,
    count(DISTINCT o.value) FILTER (WHERE o.kind = 'identifier') AS identifiers, count(DISTINCT o.value) FILTER (WHERE o.kind = 'endpoint') AS endpoints
  FROM s LEFT JOIN p o ON s.doc_id = o.doc_id AND s.scope = o.scope AND o.kind IN ('identifier', 'endpoint') AND o.start BETWEEN s.start - {SPAN} AND s.start + length(s.value) + {SPAN}
    AND (o.start < s.start OR o.start + length(o.value) > s.start + length(s.value))
  GROUP BY ALL
)
SELECT doc_id, scope::INT AS scope, start::INT AS start, length::INT AS length, strength, fingerprint, identifiers::INT AS identifiers, endpoints::INT AS endpoints
FROM near WHERE strength = 'strong' OR identifiers + endpoints > 0
"""
