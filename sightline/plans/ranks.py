"""Queries over search positions, webmaster facts and calls, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import ranks as R
from sightline.sources.adapters import cte, facts

ASOF = "2024-01-20"
LIMITS = {"t0": 10, "t1": 100000}


def _one(name, f):
    return lambda spark, sf_dir: f(facts(spark, sf_dir, name))


def _merged(spark, sf_dir):
    return R.replace_merge(facts(spark, sf_dir, "ranks"), ["keyword_id", "day", "engine"], ["inserted_at", "version"])


def latest_rank(spark, sf_dir):
    out = R.latest(facts(spark, sf_dir, "ranks"), ["keyword_id", "engine"], [F.desc("day"), F.desc("inserted_at"), F.desc("version")])
    return out.select("keyword_id", "engine", "day", "position", "found_url")


def previous_position(spark, sf_dir):
    return R.previous_position(_merged(spark, sf_dir)).select("keyword_id", "engine", "day", "position", "previous_position", "previous_day", "change")


def rank_table(spark, sf_dir):
    return R.rank_table(facts(spark, sf_dir, "kw"), facts(spark, sf_dir, "ranks"), facts(spark, sf_dir, "web"), ASOF)


def url_keywords(spark, sf_dir):
    w = facts(spark, sf_dir, "web").where(F.col("page_url") == "https://site.example/p7").groupBy("keyword_id").agg(F.sum("impressions").alias("impressions"))
    return w.orderBy(F.desc("impressions"), "keyword_id")


def page_queries(spark, sf_dir):
    """Every query of every page with its place by impressions within the page."""
    w = facts(spark, sf_dir, "web").groupBy("page_url", "query_text").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return w.withColumn("place", F.row_number().over(Window.partitionBy("page_url").orderBy(F.desc("impressions"), "query_text")))


def content_gap(spark, sf_dir):
    return R.content_gap(facts(spark, sf_dir, "web"), facts(spark, sf_dir, "kw"))


def project_dashboard(spark, sf_dir):
    return R.project_dashboard(facts(spark, sf_dir, "kw"), facts(spark, sf_dir, "ranks"), ASOF)


def project_list(spark, sf_dir):
    """Keyword count and last collection, each side aggregated before the join."""
    k = facts(spark, sf_dir, "kw")
    r = facts(spark, sf_dir, "ranks").join(k.select("keyword_id", "project_id"), "keyword_id").groupBy("project_id").agg(F.max("inserted_at").alias("last_collected"))
    return k.groupBy("project_id").agg(F.count("*").alias("keywords")).join(r, "project_id", "left")


def upserted(spark, sf_dir):
    r = facts(spark, sf_dir, "ranks")
    keys = ["keyword_id", "day", "engine"]
    old, new = (R.replace_merge(r.where(c), keys, ["inserted_at", "version"]) for c in ("version % 3 <> 0", "version % 3 = 0"))
    return R.upsert(old, new, keys).groupBy("engine").agg(F.count("*").alias("rows"), F.sum("version").alias("versions"))


def inserted(spark, sf_dir):
    q = facts(spark, sf_dir, "q").select("query_id", "query_text")
    return R.insert_absent(q.where("query_id % 2 = 0"), q.where("query_id % 2 = 1"), F.lower(F.trim("query_text")), "query_id")


def counters(spark, sf_dir):
    r = facts(spark, sf_dir, "ranks").where("found_url is not null")
    seen = lambda d: d.groupBy("found_url").agg(F.count("*").alias("mentions"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return R.add_counts(seen(r.where("version % 2 = 0")), seen(r.where("version % 2 = 1")), "found_url")


QUERIES = {
    "latest_rank": latest_rank,
    "previous_position": previous_position,
    "rank_table": rank_table,
    "url_keywords": url_keywords,
    "page_queries": page_queries,
    "chart_spine": _one("ranks", lambda d: R.chart(d, ASOF, 30)),
    "dashboard_trend": project_dashboard,
    "project_list": project_list,
    "webmaster_rollup": _one("web", R.rollup),
    "webmaster_weighted": _one("web", R.weighted),
    "content_gap": content_gap,
    "replace_merge": lambda spark, sf_dir: _merged(spark, sf_dir).select("keyword_id", "day", "engine", "position", "version"),
    "upsert_merge": upserted,
    "insert_absent": inserted,
    "additive_merge": counters,
    "retention_filter": _one("ranks", lambda d: R.retained(d, "2024-01-15", 0).groupBy("day").agg(F.count("*").alias("n"))),
    "quota": _one("kw", lambda d: R.over_quota(d, LIMITS, 50)),
    "failure_streak": _one("calls", lambda d: R.failure_streaks(d, 2)),
    "sliding_load": _one("calls", lambda d: R.sliding_load(d, 3600)),
    "resilience_runs": _one("calls", R.run_summary),
    "domain_best_rank": _one("ranks", lambda d: R.domain_best(d, "Site.example/p1")),
}

_POS = "CASE WHEN position > 0 THEN position END"
_MERGED = "merged AS (SELECT * FROM ranks QUALIFY row_number() OVER (PARTITION BY keyword_id, day, engine ORDER BY inserted_at DESC, version DESC) = 1)"
_WEIGHTED = """SELECT keyword_id, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, nullif(round(sum(position * impressions) / nullif(sum(impressions), 0)::DOUBLE, 2), 0) AS avg_position,
  nullif(round(sum(clicks) * 100.0::DOUBLE / nullif(sum(impressions), 0)::DOUBLE, 2), 0) AS ctr FROM {} GROUP BY 1"""

ORACLES = {
    "latest_rank": cte("ranks") + "SELECT keyword_id, engine, day, position, found_url FROM ranks QUALIFY row_number() OVER (PARTITION BY keyword_id, engine ORDER BY day DESC, inserted_at DESC, version DESC) = 1",
    "previous_position": cte("ranks") + f", {_MERGED}, p AS (SELECT *, lag(position) OVER w AS previous_position, lag(day) OVER w AS previous_day FROM merged WINDOW w AS (PARTITION BY keyword_id, engine ORDER BY day)) "
    f"SELECT keyword_id, engine, day, position, previous_position, previous_day, (CASE WHEN previous_position > 0 THEN previous_position END) - ({_POS}) AS change FROM p",
    "rank_table": cte("kw", "ranks", "web") + f""", newest AS (SELECT keyword_id, day, {_POS} AS position, found_url FROM ranks QUALIFY row_number() OVER (PARTITION BY keyword_id ORDER BY day DESC, engine DESC, version DESC) = 1),
recent AS (SELECT * FROM web WHERE day BETWEEN DATE '{ASOF}' - 7 AND DATE '{ASOF}'), sums AS ({_WEIGHTED.format("recent")})
SELECT keyword_id, keyword, day, position, rtrim(found_url, '/') = rtrim(target_url, '/') AS url_match, impressions, clicks, avg_position, ctr FROM kw LEFT JOIN newest USING (keyword_id) LEFT JOIN sums USING (keyword_id) WHERE active""",
    "url_keywords": cte("web") + "SELECT keyword_id, sum(impressions)::BIGINT AS impressions FROM web WHERE page_url = 'https://site.example/p7' GROUP BY 1 ORDER BY 2 DESC, 1",
    "page_queries": cte("web") + "SELECT page_url, query_text, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, row_number() OVER (PARTITION BY page_url ORDER BY sum(impressions) DESC, query_text)::INT AS place FROM web GROUP BY page_url, query_text",
    "chart_spine": cte("ranks") + f""", r AS (SELECT * FROM ranks WHERE day BETWEEN DATE '{ASOF}' - 30 AND DATE '{ASOF}'), spine AS (SELECT engine, (DATE '{ASOF}' - 30 + i::INT)::DATE AS day FROM (SELECT DISTINCT engine FROM r), range(0, 31) AS x(i)),
best AS (SELECT day, engine, min({_POS}) AS best, count(*) AS checks FROM r GROUP BY ALL) SELECT day, engine, best, checks FROM spine LEFT JOIN best USING (day, engine)""",
    "dashboard_trend": cte("kw", "ranks") + f""", k AS (SELECT project_id, count(*) FILTER (active) AS keyword_count FROM kw GROUP BY 1),
r AS (SELECT project_id, round(avg(CASE WHEN day = DATE '{ASOF}' THEN {_POS} END), 1) AS avg_today, round(avg(CASE WHEN day = DATE '{ASOF}' - 7 THEN {_POS} END), 1) AS avg_before, max(day) AS last_day FROM ranks JOIN (SELECT keyword_id, project_id FROM kw WHERE active) USING (keyword_id) GROUP BY 1)
SELECT project_id, keyword_count, avg_today, avg_before, last_day, round(avg_before - avg_today, 1) AS trend FROM k LEFT JOIN r USING (project_id)""",
    "project_list": cte("kw", "ranks") + ", r AS (SELECT project_id, max(inserted_at) AS last_collected FROM ranks JOIN (SELECT keyword_id, project_id FROM kw) USING (keyword_id) GROUP BY 1) SELECT project_id, keywords, last_collected FROM (SELECT project_id, count(*) AS keywords FROM kw GROUP BY 1) LEFT JOIN r USING (project_id)",
    "webmaster_rollup": cte("web") + ", t AS (SELECT *, sum(impressions) OVER p AS si, sum(clicks) OVER p AS sc FROM web WINDOW p AS (PARTITION BY keyword_id, day)) SELECT keyword_id, day, si::BIGINT AS impressions, sc::BIGINT AS clicks, position, page_url FROM t QUALIFY row_number() OVER (PARTITION BY keyword_id, day ORDER BY impressions DESC, ord) = 1",
    "webmaster_weighted": cte("web") + _WEIGHTED.format("web"),
    "content_gap": cte("web", "kw") + """ SELECT rtrim(page_url, '/') AS page, lower(query_text) AS word, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks FROM web
WHERE rtrim(page_url, '/') IN (SELECT rtrim(target_url, '/') FROM kw WHERE active AND target_url IS NOT NULL) AND lower(query_text) NOT IN (SELECT lower(keyword) FROM kw WHERE active) GROUP BY ALL""",
    "replace_merge": cte("ranks") + f", {_MERGED} SELECT keyword_id, day, engine, position, version FROM merged",
    "upsert_merge": cte("ranks") + ", m AS (SELECT * FROM ranks QUALIFY row_number() OVER (PARTITION BY keyword_id, day, engine ORDER BY version % 3 = 0 DESC, inserted_at DESC, version DESC) = 1) SELECT engine, count(*) AS rows, sum(version)::BIGINT AS versions FROM m GROUP BY 1",
    "insert_absent": cte("q") + " SELECT query_id, query_text FROM q WHERE query_id % 2 = 1 AND lower(trim(query_text)) NOT IN (SELECT lower(trim(query_text)) FROM q WHERE query_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY lower(trim(query_text)) ORDER BY query_id) = 1",
    "additive_merge": cte("ranks") + "SELECT found_url, count(*) AS mentions, min(day) AS first_seen, max(day) AS last_seen FROM ranks WHERE found_url IS NOT NULL GROUP BY 1",
    "retention_filter": cte("ranks") + "SELECT day, count(*) AS n FROM ranks WHERE day >= DATE '2024-01-01' GROUP BY 1",
    "quota": cte("kw") + "SELECT tenant, count(*) AS used, CASE tenant WHEN 't0' THEN 10 WHEN 't1' THEN 100000 ELSE 50 END AS allowed FROM kw WHERE active GROUP BY 1 HAVING count(*) > CASE tenant WHEN 't0' THEN 10 WHEN 't1' THEN 100000 ELSE 50 END",
    "failure_streak": cte("calls") + ", r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY vendor ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS run FROM calls) SELECT vendor, count(*) AS failures, min(ts) AS since, max(ts) AS until FROM r WHERE NOT ok GROUP BY vendor, run HAVING count(*) >= 2",
    "sliding_load": cte("calls") + "SELECT call_id, vendor, count(*) OVER w AS requests, (sum(tokens) OVER w)::BIGINT AS load FROM calls WINDOW w AS (PARTITION BY vendor ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)",
    "resilience_runs": cte("calls") + "SELECT prompt_id, count(*) AS runs, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'censored') AS censored, count(*) FILTER (status = 'failed') AS failed, round(sum(cost_micros) / 1e6, 6) AS cost, floor(avg(latency_ms))::BIGINT AS avg_latency FROM calls GROUP BY 1",
    "domain_best_rank": cte("ranks") + "SELECT keyword_id, min(CASE WHEN contains(lower(found_url), 'site.example/p1') AND position > 0 THEN position END) AS best FROM ranks GROUP BY 1",
}
