"""Search positions, webmaster facts and table maintenance.

Latest and previous rows come from one window over a key instead of a self-join, roll-ups from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under order (newest first); order ends with a unique column. One shuffle on the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_merge(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Last write wins per key."""
    return latest(df, keys, [F.desc(c) for c in newest])


def upsert(state: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """State with delta's rows replacing those of the same key; delta holds a key once."""
    return state.join(delta.select(*keys), keys, "left_anti").unionByName(delta)


def insert_absent(state: DataFrame, rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows whose folded key is neither in state nor earlier among the rows."""
    first = rows.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(order))).where("_n = 1").drop("_n")
    return first.join(state.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def add_counts(state: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Additive merge: counts add up, last_seen is the later one, first_seen the earlier."""
    d = delta.withColumnsRenamed({"mentions": "_m", "first_seen": "_f", "last_seen": "_l"})
    out = state.join(d, key, "full")
    return out.select(
        key, (F.coalesce("mentions", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("mentions"), F.least("first_seen", "_f").alias("first_seen"), F.greatest("last_seen", "_l").alias("last_seen")
    )


def cleaned(position: Column) -> Column:
    return F.when(position > 0, position)


def previous_position(df: DataFrame) -> DataFrame:
    """Each row with the position of the key's latest strictly earlier day, and the change (positive is better)."""
    w = Window.partitionBy("keyword_id", "engine").orderBy("day")
    out = df.withColumns({"previous_position": F.lag("position").over(w), "previous_day": F.lag("day").over(w)})
    return out.withColumn("change", cleaned(F.col("previous_position")) - cleaned(F.col("position")))


def rank_table(keywords: DataFrame, ranks: DataFrame, web: DataFrame, asof: str) -> DataFrame:
    """Active keywords with latest rank, URL match, and the last seven days' webmaster sums; keywords without facts stay."""
    newest = latest(ranks, ["keyword_id"], [F.desc("day"), F.desc("engine"), F.desc("version")]).select("keyword_id", "day", cleaned(F.col("position")).alias("position"), "found_url")
    since = F.date_sub(F.lit(asof).cast("date"), 7)
    sums = weighted(web.where(F.col("day").between(since, F.lit(asof).cast("date"))))
    strip = lambda c: F.rtrim(F.col(c), F.lit("/"))
    k = keywords.where("active").join(newest, "keyword_id", "left").join(sums, "keyword_id", "left")
    return k.select("keyword_id", "keyword", "day", "position", (strip("found_url") == strip("target_url")).alias("url_match"), "impressions", "clicks", "avg_position", "ctr")


def weighted(web: DataFrame) -> DataFrame:
    """Sums by keyword, impression-weighted position and click rate; zero positions and rates are shown as null."""
    g = web.groupBy("keyword_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum(F.col("position") * F.col("impressions")).alias("_p")
    )
    seen = F.nullif(F.col("impressions"), F.lit(0)).cast("double")
    shown = lambda c: F.nullif(F.round(c, 2), F.lit(0.0))
    return g.select("keyword_id", "impressions", "clicks", shown(F.try_divide("_p", seen)).alias("avg_position"), shown(F.try_divide(F.col("clicks") * 100.0, seen)).alias("ctr"))


def rollup(web: DataFrame) -> DataFrame:
    """Sums by keyword and day; position and page of the row with most impressions, the first one on ties."""
    top = F.max_by(F.struct("position", "page_url"), F.struct("impressions", -F.col("ord")))
    return web.groupBy("keyword_id", "day").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), top.alias("t")).select("keyword_id", "day", "impressions", "clicks", "t.position", "t.page_url")


def content_gap(web: DataFrame, keywords: DataFrame) -> DataFrame:
    """Queries that reach tracked pages and are not tracked themselves."""
    strip = lambda c: F.rtrim(F.col(c), F.lit("/"))
    pages = keywords.where("active and target_url is not null").select(strip("target_url").alias("page"))
    words = keywords.where("active").select(F.lower("keyword").alias("word"))
    w = web.withColumns({"page": strip("page_url"), "word": F.lower("query_text")}).join(pages, "page", "left_semi").join(words, "word", "left_anti")
    return w.groupBy("page", "word").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))


def chart(ranks: DataFrame, asof: str, days: int) -> DataFrame:
    """Best position by day and engine over a full date spine; days without a rank are null."""
    end = F.lit(asof).cast("date")
    r = ranks.where(F.col("day").between(F.date_sub(end, days), end))
    best = r.groupBy("day", "engine").agg(F.min(cleaned(F.col("position"))).alias("best"), F.count("*").alias("checks"))
    spine = r.select("engine").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(end, days), end)))
    return spine.join(best, ["day", "engine"], "left")


def project_dashboard(keywords: DataFrame, ranks: DataFrame, asof: str) -> DataFrame:
    """Keywords, mean position on the day and seven days before, trend and last day; projects without active keywords stay."""
    day, before = F.lit(asof).cast("date"), F.date_sub(F.lit(asof).cast("date"), 7)
    k = keywords.groupBy("project_id").agg(F.count_if("active").alias("keyword_count"))
    r = ranks.join(keywords.where("active").select("keyword_id", "project_id"), "keyword_id").groupBy("project_id").agg(
        F.round(F.avg(F.when(F.col("day") == day, cleaned(F.col("position")))), 1).alias("avg_today"),
        F.round(F.avg(F.when(F.col("day") == before, cleaned(F.col("position")))), 1).alias("avg_before"),
        F.max("day").alias("last_day"),
    )
    return k.join(r, "project_id", "left").withColumn("trend", F.round(F.col("avg_before") - F.col("avg_today"), 1))


def retained(df: DataFrame, asof: str, months: int) -> DataFrame:
    """Rows of months that retention keeps: month >= this month - months."""
    return df.where(F.col("day") >= F.add_months(F.trunc(F.lit(asof).cast("date"), "MM"), -months))


def over_quota(keywords: DataFrame, limits: dict[str, int], default: int) -> DataFrame:
    pairs = [F.lit(x) for kv in limits.items() for x in kv]
    used = keywords.where("active").groupBy("tenant").agg(F.count("*").alias("used"))
    allowed = F.coalesce(F.create_map(*pairs)[F.col("tenant")], F.lit(default))
    return used.withColumn("allowed", allowed).where("used > allowed")


def failure_streaks(calls: DataFrame, least: int, bucket: int = 3600) -> DataFrame:
    """Runs of at least so many failures in a row by vendor: the successes so far number the runs.

    Successes are counted inside buckets of so many seconds; what came before a bucket is a running sum over the vendor's buckets, a row each. So a vendor's calls are
    spread over all tasks, and a run that spans buckets is put together where runs are counted. Calls of a null vendor are those of one vendor; null times come first.
    """
    d = calls.withColumn("_bucket", F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (bucket * 1_000_000)), F.lit(-(1 << 62))))
    inside = Window.partitionBy("vendor", "_bucket").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    w = Window.partitionBy("_vendor").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(F.col("vendor").alias("_vendor"), F.col("_bucket").alias("_of")).agg(F.sum(F.col("ok").cast("int")).alias("n"))
    before = before.select("_vendor", "_of", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))
    r = d.withColumn("run", F.coalesce(F.sum(F.col("ok").cast("int")).over(inside), F.lit(0))).where("not ok")
    r = r.join(before, F.col("vendor").eqNullSafe(F.col("_vendor")) & (F.col("_bucket") == F.col("_of"))).withColumn("run", F.col("run") + F.col("_before"))
    g = r.groupBy("vendor", "run").agg(F.count("*").alias("failures"), F.min("ts").alias("since"), F.max("ts").alias("until"))
    return g.where(F.col("failures") >= least).drop("run")


def sliding_load(calls: DataFrame, seconds: int, widths: int = 8) -> DataFrame:
    """Requests and tokens of the vendor's last seconds, at each call.

    A call counts from its time on and no longer once the seconds are over, so a running sum of both gives each call its figures, however many calls are near it.
    A vendor's time is cut into buckets of so many widths; what still counts at the end of a bucket counts from the start of the next one, so each bucket is a task's
    work by itself. tokens are whole numbers. Calls of a null time see one another only.
    """
    us, reach = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    d = calls.select("call_id", "vendor", "tokens", us.alias("us")).withColumn("bucket", F.floor(F.col("us") / (reach * widths)))
    edge, over = (F.col("bucket") + 1) * (reach * widths), F.col("us") + reach + 1
    none = F.lit(None).cast(calls.schema["call_id"].dataType)
    row = lambda at, bucket, sign, call_id: F.struct(at.alias("us"), bucket.alias("bucket"), F.lit(sign).alias("sign"), call_id.alias("call_id"), F.lit(call_id is not none).alias("own"))
    here, after = F.col("bucket"), F.col("bucket") + 1
    starts = row(F.col("us"), here, 1, F.col("call_id"))
    ends = F.when(over < edge, F.array(starts, row(over, here, -1, none))).when(over >= edge, F.array(starts, row(edge, after, 1, none), row(over, after, -1, none)))
    d = d.select("vendor", "tokens", F.explode(F.coalesce(ends, F.array(starts))).alias("r")).select("vendor", "tokens", "r.*")
    w = Window.partitionBy("vendor", "bucket").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    known = F.sum(F.when(F.col("tokens").isNotNull(), F.col("sign")).otherwise(0)).over(w)
    load = F.sum(F.coalesce("tokens", F.lit(0)) * F.col("sign")).over(w)
    return d.select("call_id", "vendor", F.sum("sign").over(w).alias("requests"), F.when(known > 0, load).alias("load"), "own").where("own").drop("own")


def run_summary(calls: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return calls.groupBy("prompt_id").agg(
        F.count("*").alias("runs"), of("success"), of("censored"), of("failed"), F.round(F.sum("cost_micros") / 1e6, 6).alias("cost"), F.floor(F.avg("latency_ms")).cast("long").alias("avg_latency")
    )


def domain_best(ranks: DataFrame, domain: str) -> DataFrame:
    """Best position of a domain by keyword; null where it is not found."""
    hit = F.lower("found_url").contains(domain.lower()) & (F.col("position") > 0)
    return ranks.groupBy("keyword_id").agg(F.min(F.when(hit, F.col("position"))).alias("best"))
