"""What the operators share: working tables in the cluster's shared folder, row keys, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Largest row count and bytes that a side may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Bytes of an Arrow batch; a longer text comes alone, whole.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, in local mode only: a temporary folder of this machine."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sylva-")
        spark.conf.set("spark.checkpoint.dir", found)
        _made.append((spark, found))
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and reread: lineage ends there, and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylva/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Removes the working tables written so far; frames read from them end with it."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return


atexit.register(cleanup)


def small(df: DataFrame, bytes_a_row: int, count: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough, else as it is, for a shuffled join."""
    rows = df.count() if count is None else count
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * bytes_a_row <= BROADCAST_BYTES else df


#: Rows of one join key from which on they aren't shuffled to one task.
HOT = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, spread: str, how: str = "inner") -> DataFrame:
    """left joined with right, unique in key, by key. Keys of over HOT rows, as right's column `rows` counts them, are
    looked up in a broadcast table, which has a row for each, left's rows / HOT at most; their rows take column `spread`,
    of key's type, as the key of the shuffle that the others need. The result lacks `rows`."""
    names = [c for c in right.columns if c not in (key, rows)]
    hot = right.filter(F.col(rows) > HOT).select(F.col(key).alias("__hot"), F.struct(*names).alias("__h"))
    cold = right.filter(F.col(rows) <= HOT).select(F.col(key).alias("__cold"), F.struct(*names).alias("__c"))
    joined = left.join(F.broadcast(hot), left[key] == F.col("__hot"), "left")
    joined = joined.withColumn("__k", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.col(spread)))
    joined = joined.join(cold, F.col("__k") == F.col("__cold"), "left").withColumn("__r", F.coalesce("__h", "__c"))
    if how == "inner":
        joined = joined.filter("__r is not null")
    return joined.select(*left.columns, *(F.col(f"__r.{c}").alias(c) for c in names))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("\0null")))


def text_digest(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.md5(F.coalesce(text, F.lit("\0null")))


def row_key(df: DataFrame) -> Column:
    """96 bits or so that tell rows of documents apart by identifier and text; repeated rows share it."""
    ident = F.coalesce(df["doc_id"].cast("string"), F.lit("\0null"))
    text = F.coalesce(df["text"], F.lit("\0null"))
    return F.concat(F.hex(F.xxhash64(ident, text)), F.hex(F.hash(text, ident)))


def _few_bytes(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ARROW_BYTES, that Python workers stay small; a lower bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).strip().lower()
    if now != f"{ARROW_BYTES}b":
        unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(now.rstrip("b")[-1:], 0)
        digits = now.rstrip("bkmgt")
        if not digits.isdigit() or int(digits) << unit > ARROW_BYTES or int(digits) == 0:
            spark.conf.set(name, f"{ARROW_BYTES}b")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, first match by exact name, whatever other columns df carries, clashing names included."""
    _few_bytes(df.sparkSession)
    at = {}
    for i, n in enumerate(df.columns):
        at.setdefault(n, i)
    if lost := [n for n in names if n not in at]:
        raise ValueError(f"columns are missing: {lost}")
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{at[n]}").alias(n) for n in names))


DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
