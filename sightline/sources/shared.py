"""Tables cut from their lineage in the folder that driver and executors share. The folder belongs to the session; whoever sets it clears it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one of this machine: on a local master only, where driver and executors are one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sightline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sightline-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", free: bool = False) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: no lineage, and safe when executors are lost.

    free: the shuffle files of the write go when it ends. Else they stay until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    before = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
