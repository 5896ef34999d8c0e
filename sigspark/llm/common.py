"""Tables, intermediate results in the shared folder, bounded Bloom filters and ranks inside large keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import shared_folder

#: bits of a broadcast Bloom filter: 8 MB whatever the input
BLOOM_BITS = 1 << 26

#: bytes of text that go to a Python worker at once; the JVM holds a batch outside its heap and grows it by doubling
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by `BATCH_BYTES` where it allows larger ones: whole texts are long rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key) or "").lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: folders written inside `settled`; a thread or task that runs beside has its own list
_temporary: ContextVar[list[str] | None] = ContextVar("temporary", default=None)
#: keys with more than this share of the rows are split: there are at most so many of them
HOT_KEYS = 512
SALTS = 64


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the session names."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    paths = _temporary.get()
    if paths is not None:
        paths.append(path)
    return path


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of `make` as a written table; the intermediate tables that it wrote are deleted."""
    paths: list[str] = []
    before = _temporary.set(paths)
    try:
        path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
        df = make()
        df.write.parquet(path)
    finally:
        _temporary.reset(before)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            p.getFileSystem(conf).delete(p, True)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder and read back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


class Bloom:
    """Membership filter over 64-bit hashes, at most `BLOOM_BITS` bits. A full filter lets more rows pass, never fewer:
    an exact join always follows."""

    def __init__(self, hashes: DataFrame, column: str):
        h = F.col(column).bitwiseAND(F.lit(BLOOM_BITS - 1))
        words = (hashes.select(F.shiftright(h, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
                 .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
        self.words = np.zeros(BLOOM_BITS >> 6, np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    def shared(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self.words)

    @staticmethod
    def hits(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64, copy=False).view(np.uint64) & np.uint64(BLOOM_BITS - 1)
        return (words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def ranked(df: DataFrame, keys: list[str], part: Column, order: list, name: str = "_rank", parts: str = "_part") -> DataFrame:
    """0-based rank inside (keys) by (part, order), with one task per (keys, part).

    `part` is a small number spread evenly over the rows of a key (bits of a hash), so no key is sorted in one task.
    """
    x = df.withColumn(parts, part)
    n = x.groupBy(*keys, parts).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(parts).rowsBetween(W.unboundedPreceding, -1))
    n = n.select(*keys, parts, F.coalesce(before, F.lit(0)).alias("_before"))
    x = x.join(n, [*keys, parts])
    inside = F.row_number().over(W.partitionBy(*keys, parts).orderBy(*order)) - 1
    return x.withColumn(name, (F.col("_before") + inside).cast("long")).drop("_before")


def row_hash(df: DataFrame) -> Column:
    """64 bits of a whole row; equal for repeated rows."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with `table`, which has one row per key and in `count` the number of rows that meet it. Keys with more
    than 1/512 of all rows are dealt to 64 tasks each; there are at most 512 of them, so their list is broadcast."""
    hot = table.where(F.col(count) > max(1000, total // HOT_KEYS)).select(*keys, F.lit(True).alias("_hot"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    r = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    t = table.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return r.join(t, [*keys, "_salt"], how).drop("_salt")
