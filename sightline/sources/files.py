"""Readers of rank files and webmaster dumps, and sinks for exports and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The marker of section lines and the section that counts.
MARKER, SECTION = "JM_PMETA", "Исходники"


def rank_file(spark: SparkSession, path: str, marker: str = MARKER, section: str = SECTION) -> DataFrame:
    """(file, keyword, position, url) of tab-separated, sectioned, possibly gzipped files; a file is one row until it is split into lines.

    Rows need three fields and a whole-number position; keywords are trimmed and lower-cased.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    f = F.split("line", "\t")
    w = Window.partitionBy("file").orderBy("at")
    tagged = lines.withColumn("section", F.last(F.when(f[0] == marker, F.trim(F.coalesce(F.get(f, F.lit(1)), F.lit("")))), ignorenulls=True).over(w))
    rows = tagged.where((F.col("section") == section) & (f[0] != marker) & (F.size(f) >= 3))
    return rows.select("file", F.lower(F.trim(f[0])).alias("keyword"), F.expr("try_cast(trim(split(line, '\t')[1]) AS INT)").alias("position"), F.trim(F.get(f, F.lit(2))).alias("url")).where("position is not null")


def webmaster_dump(spark: SparkSession, path: str) -> DataFrame:
    """(day, query, page, impressions, clicks, position, ctr) of rows {keys: [date, query, page], ...}; rows with fewer keys are left out."""
    d = spark.read.schema("keys array<string>, impressions long, clicks long, position double, ctr double").json(path).where(F.size("keys") >= 3)
    return d.select(F.expr("try_cast(keys[0] AS DATE)").alias("day"), F.col("keys")[1].alias("query"), F.col("keys")[2].alias("page"), "impressions", "clicks", "position", "ctr")


def query_stats_dump(spark: SparkSession, path: str, asof: str) -> DataFrame:
    """The second engine's rows {query_text, indicators: {...}}; they belong to the day before asof."""
    schema = "query_text string, indicators struct<TOTAL_SHOWS: double, TOTAL_CLICKS: double, AVG_SHOW_POSITION: double>"
    d = spark.read.schema(schema).json(path).where("query_text is not null")
    i = F.col("indicators")
    return d.select(
        F.date_sub(F.lit(asof).cast("date"), 1).alias("day"), F.lower(F.trim("query_text")).alias("query"), F.coalesce(i["TOTAL_SHOWS"], F.lit(0.0)).cast("long").alias("impressions"),
        F.coalesce(i["TOTAL_CLICKS"], F.lit(0.0)).cast("long").alias("clicks"), i["AVG_SHOW_POSITION"].alias("position"),
    )


def write_positions_csv(df: DataFrame, path: str) -> None:
    """keyword, search_engine, date, position, url; unknown positions and urls are empty. Range-partitioned, so files are in order without one task."""
    pos = F.when(F.col("position") > 0, F.col("position").cast("string")).otherwise("")
    out = df.select("keyword", F.col("engine").alias("search_engine"), F.date_format("day", "yyyy-MM-dd").alias("date"), pos.alias("position"), F.coalesce("found_url", F.lit("")).alias("url"))
    out.repartitionByRange("keyword", F.desc("date")).sortWithinPartitions("keyword", F.desc("date"), "search_engine").write.option("header", True).option("emptyValue", "").csv(path)


def append_history(df: DataFrame, path: str) -> None:
    """Appends rows to a history by month."""
    df.withColumn("month", F.date_format("day", "yyyy_MM")).write.mode("append").partitionBy("month").parquet(path)


def read_history(spark: SparkSession, path: str, since: str, until: str) -> DataFrame:
    """Rows of a date range: the bound on the month prunes folders, the bound on the day is exact."""
    month = lambda d: F.date_format(F.lit(d).cast("date"), "yyyy_MM")
    d = spark.read.parquet(path)
    return d.where(F.col("month").cast("string").between(month(since), month(until)) & F.col("day").between(F.lit(since).cast("date"), F.lit(until).cast("date"))).drop("month")
