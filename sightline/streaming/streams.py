"""Structured Streaming forms of the ingest and monitoring operators.

Each takes a streaming DataFrame and returns one; run_available() drains what is there and returns the result as a table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sightline.sources.shared import shared_dir, written


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 1) -> DataFrame:
    """The table as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a single-file table is matched by a pattern, since a file source lists folders
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{path[: -len('.parquet')]}*.parquet")


def daily_rates(stream: DataFrame, late: str = "3650 days") -> DataFrame:
    """Calls and failures by day and event type; late rows inside the watermark still count."""
    d = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", "1 day")
    g = d.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("total"))
    return g.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First arrival of each key inside the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sliding_load(stream: DataFrame, width: str = "60 seconds", step: str = "10 seconds", late: str = "3650 days") -> DataFrame:
    d = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = d.groupBy(F.window("ts", width, step).alias("w"), (F.col("user_id") % 6).alias("vendor")).agg(F.count("*").alias("requests"))
    return g.select(F.col("w.start").alias("start"), "vendor", "requests")


def counters(stream: DataFrame) -> DataFrame:
    """Running counts with first and last time by user."""
    return stream.groupBy("user_id").agg(F.count("*").alias("mentions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def run_available(stream: DataFrame) -> DataFrame:
    """Runs a query until its input is used up; every micro-batch replaces the result table, so reruns after a failure are idempotent."""
    spark = stream.sparkSession
    base = shared_dir(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/result")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/result")


#: Buckets of an upserted table; fixed when its first batch is written.
BUCKETS = 64


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, int]] | None:
    """(batch, slot of each bucket) of the newest manifest; none before the first batch."""
    try:
        m = spark.read.schema("bucket int, slot int, batch long").parquet(f"{path}/manifest")
    except AnalysisException:  # no such folder yet
        return None
    newest = m.agg(F.max("batch")).first()[0]
    return None if newest is None else (newest, {r["bucket"]: r["slot"] for r in m.where(F.col("batch") == newest).collect()})  # a row for each bucket


def _rows_of(spark: SparkSession, path: str, schema: StructType, slots: dict[int, int]) -> DataFrame:
    """Rows of some buckets in the slots they are in; other folders are pruned."""
    d = spark.read.schema(StructType([*schema.fields]).add("slot", "integer").add("bucket", "integer")).parquet(f"{path}/data")
    here = F.lit(False)
    for k in (0, 1):
        here = here | ((F.col("slot") == k) & F.col("bucket").isin([b for b, s in slots.items() if s == k]))
    return d.where(here).drop("slot")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], newest: list[str], buckets: int = BUCKETS) -> None:
    """Continuous ingest, last write wins: each micro-batch is merged into the table at path by key. read_upserted reads it.

    Rows live in buckets by hash of the key, and each bucket in one of two slots. A batch reads and rewrites only the buckets it touches, each into the slot
    that it is not in; one small file, the batch's manifest, then says where every bucket is. Readers follow the newest manifest, so they see all of a batch or nothing
    of it, and a batch that is run again after a failure makes the same table. No more than two versions of a bucket are kept. Null keys are a key.
    """
    from sightline.operators.ranks import replace_merge

    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, n: int) -> None:
        rows = written(batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "batch")
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets
        before = _current(spark, path)
        slots = before[1] if before else {}
        held = {b: slots[b] for b in touched if b in slots}
        if held:
            rows = rows.unionByName(_rows_of(spark, path, schema, held))
        to = {b: 1 - slots.get(b, 1) for b in touched}
        if touched:
            slot = F.when(F.col("bucket").isin([b for b, k in to.items() if k]), 1).otherwise(0)
            merged = written(replace_merge(rows, ["bucket", *keys], newest).withColumn("slot", slot), "merged")
            # a bucket is one task's work and one folder's files
            merged.repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "bucket").parquet(f"{path}/data")
        now = spark.createDataFrame([(b, s, n) for b, s in {**slots, **to}.items()], "bucket int, slot int, batch long")
        now.coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    q = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()


def read_upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that upsert_stream keeps at path, as of the newest manifest; empty before the first batch."""
    now = _current(spark, path)
    if not now or not now[1]:
        return spark.createDataFrame([], schema)
    return _rows_of(spark, path, schema, now[1]).drop("bucket")


def run_appended(stream: DataFrame) -> DataFrame:
    """Drains an append-mode stream into a table."""
    base = shared_dir(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{base}/result").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/result")
