"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sample blocks are wide rows: bound an Arrow batch by bytes, not by ten thousand rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName("sigspark")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false"))
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Sample blocks are rows of megabytes: warn when the session does not bound Arrow batches by bytes (`SETTINGS` does)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").lower()
    unbounded = now in ("", "-1") or now.rstrip("b").isdigit() and not 0 < int(now.rstrip("b")) <= 1 << 28
    if unbounded:
        warnings.warn(f"{key} is {now or 'not set'}: set it to {SETTINGS[key]} where the session is made", stacklevel=3)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: what the cluster names in spark.checkpoint.dir. Only a session whose driver is its
    only executor, as in tests, may fall back to a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sigspark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: later readers prune columns and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sigspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
