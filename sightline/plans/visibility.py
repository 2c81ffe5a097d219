"""Queries over answer facts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import visibility as V
from sightline.sources.adapters import COMPETITORS, cte, facts, joined, snapshots

ASOF, DAYS = "1998-06-30", 365

_RVS = "CASE mention_type WHEN 'recommended' THEN 120 WHEN 'direct' THEN 70 WHEN 'compared' THEN 50 WHEN 'negative' THEN 35 ELSE 0 END"
_W = "CASE query_type WHEN 'comparison' THEN 15 WHEN 'recommendation' THEN 12 WHEN 'brand_check' THEN 10 ELSE 8 END"
_AIVS = f"coalesce(round(least(sum({_RVS} * {_W})::DOUBLE / sum({_W})::DOUBLE, 100.0), 2), 0.0)"
_SCENARIO = "coalesce(nullif(category, ''), 'Uncategorized')"
_RATE = "coalesce(round(count(*) FILTER (brand_mentioned)::DOUBLE / nullif(count(*), 0)::DOUBLE, 4), 0.0)"
_SENT = "coalesce(nullif(lower(sentiment_label), ''), CASE mention_type WHEN 'recommended' THEN 'positive' WHEN 'negative' THEN 'negative' WHEN 'direct' THEN 'neutral' WHEN 'compared' THEN 'neutral' END)"
_NSS = f"coalesce(round((count(*) FILTER ({_SENT} = 'positive') - count(*) FILTER ({_SENT} = 'negative')) * 100.0::DOUBLE / nullif(count({_SENT}), 0)::DOUBLE, 2), 0.0)"
_RANKED = "structure_type IN ('numbered_list', 'table', 'mixed') AND position_rank IS NOT NULL"
_TOP1 = f"round(count(*) FILTER ({_RANKED} AND position_rank = 1) * 100.0::DOUBLE / nullif(count(*) FILTER ({_RANKED}), 0)::DOUBLE, 2)"
_HALL = "round(count(*) FILTER (brand_mentioned AND is_hallucination) * 100.0::DOUBLE / nullif(count(*) FILTER (brand_mentioned AND is_hallucination IS NOT NULL), 0)::DOUBLE, 2)"
_NAMED = "CASE WHEN no_map THEN 0 ELSE c1::INT + c2::INT + c3::INT END"
_SOM = f"coalesce(round(count(*) FILTER (brand_mentioned) * 100.0::DOUBLE / nullif(count(*) FILTER (brand_mentioned) + sum({_NAMED}), 0)::DOUBLE, 2), 0.0)"
_WIN = "(NOT brand_mentioned AND NOT no_map AND (c1 OR c2 OR c3 OR c4 OR c5))"
_DOMAIN = r"regexp_replace(regexp_extract(url, '://([^/?#]+)', 1), '^www\.', '')"
_HEAT = f"SELECT {_SCENARIO} AS scenario, provider, {_AIVS} AS aivs, count(*) FILTER (brand_mentioned) AS mention_count, count(*) AS total FROM sq GROUP BY ALL"
_ZONE = "CASE WHEN aivs < 20 THEN 'red' WHEN aivs < 50 THEN 'yellow' ELSE 'green' END"
_RES = "SELECT coalesce(round(avg(r), 4), 0.0) AS resilience FROM (SELECT avg(brand_mentioned::INT) AS r FROM sq GROUP BY query_id, provider)"
_GRAPH = f"SELECT {_DOMAIN} AS domain, count(*) AS citations, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, bool_or({_WIN}) AS competitor_win FROM cites GROUP BY 1"
_GLOBAL = f"SELECT {_AIVS} AS aivs, {_SOM} AS som, {_RATE} AS mention_rate, {_NSS} AS nss, {_TOP1} AS top1_win_rate, {_HALL} AS hallucination_rate, count(*) AS total_responses, (SELECT resilience FROM ({_RES})) AS resilience FROM sq"
_PROMPTED = "coalesce(contains(lower(query_text), lower(nullif(target_brand, ''))), false)"


def one(f):
    """A query that applies one operator to the joined facts."""
    return lambda spark, sf_dir: f(joined(spark, sf_dir))


def effective_sentiments(spark, sf_dir):
    s = V.effective_sentiment(F.col("sentiment_label"), F.col("mention_type"))
    return snapshots(spark, sf_dir).groupBy(F.coalesce(s, F.lit("skip")).alias("sentiment"), "provider").agg(F.count("*").alias("n"))


def details_page(spark, sf_dir):
    d = joined(spark, sf_dir).where(F.col("project_id") == 2)
    return d.orderBy(F.desc("day"), "provider", "answer_id", "query_id").offset(40).limit(20).select("answer_id", "query_id", "day", "provider", "mention_type", "query_text")


def recent_answers(spark, sf_dir):
    d = joined(spark, sf_dir).orderBy(F.desc("day"), F.desc("answer_id"), "query_id").limit(20)
    return d.select("answer_id", "day", "provider", F.left("query_text", F.lit(80)).alias("query_text"))


def export_rows(spark, sf_dir):
    d = snapshots(spark, sf_dir)
    pairs = F.map_filter("competitor_mentions", lambda k, v: v)
    return d.select(
        "answer_id", "query_id", "day", "provider", F.coalesce(F.to_json(F.array_sort(F.map_keys(pairs))), F.lit("")).alias("competitors"), F.to_json("cited_urls").alias("urls"),
        F.when(F.col("tokens") == 0, "").otherwise(F.col("tokens").cast("string")).alias("tokens"), F.when(F.col("cost_usd") == 0, "").otherwise(F.format_string("%.6f", F.round("cost_usd", 6))).alias("cost"),
    )


def custom_class_queries(spark, sf_dir):
    q = facts(spark, sf_dir, "q").where(~F.col("query_class").isin("thematic", "branded"))
    return q.select("query_id", "query_class")


def sub_brand_mentions(spark, sf_dir):
    m = V.competitor_mentions(joined(spark, sf_dir), rolled_up=False)
    root = F.split("competitor", "::")[0]
    g = m.groupBy(root.alias("root"), "competitor").agg(F.count("*").alias("own"))
    t = g.groupBy("root").agg(F.sum("own").alias("with_subs"))
    return g.join(t, "root").select("root", "competitor", "own", "with_subs")


def dashboard_totals(spark, sf_dir):
    d = joined(spark, sf_dir)
    g = d.groupBy("project_id").agg(
        F.count_distinct(F.when(F.col("active"), F.col("query_id"))).alias("active_queries"), F.count("*").alias("checks"), V.mention_rate().alias("mention_rate"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"), F.max("day").alias("last_day"),
    )
    return g


def categories(spark, sf_dir):
    return facts(spark, sf_dir, "q").where("category is not null and category <> ''").select("category").distinct()


def semi_joined_rates(spark, sf_dir):
    q = facts(spark, sf_dir, "q").where(F.col("category").ilike("%e%") & F.col("active"))
    return snapshots(spark, sf_dir).join(q, "query_id", "left_semi").groupBy("provider").agg(F.count("*").alias("checks"), V.mention_rate().alias("mention_rate"))


QUERIES = {
    "heatmap": one(V.heatmap),
    "aivs_global": one(lambda d: d.agg(V.aivs().alias("aivs"))),
    "global_metrics": one(V.global_metrics),
    "competitive_matrix": one(V.competitive_matrix),
    "competitor_counts": one(V.competitor_counts),
    "resilience": one(V.resilience),
    "resilience_groups": one(V.resilience_groups),
    "nss": one(lambda d: d.groupBy("provider").agg(V.nss().alias("nss"))),
    "top1_win_rate": one(lambda d: d.groupBy("provider").agg(V.top1_rate().alias("top1_win_rate"))),
    "hallucination_rate": one(lambda d: d.groupBy("provider").agg(V.hallucination_rate().alias("hallucination_rate"))),
    "intent_penetration": one(V.intent_penetration),
    "citation_graph": one(V.citation_graph),
    "citations_top": one(lambda d: V.citations_by_url(d, 100)),
    "cited_urls_top10": one(lambda d: V.citations_by_url(d, 10)),
    "sov_grouping_sets": one(V.share_of_voice),
    "provider_rates": one(V.provider_rates),
    "mention_rate_daily_spine": one(lambda d: V.daily_rates(d, ASOF, DAYS)),
    "advisor_rules": one(V.advisor),
    "organic_vs_prompted": one(V.organic_vs_prompted),
    "debug_contributions": one(V.contributions),
    "query_stats": lambda spark, sf_dir: V.query_stats(facts(spark, sf_dir, "q")),
    "effective_sentiments": effective_sentiments,
    "details_page": details_page,
    "recent_answers": recent_answers,
    "export_rows": export_rows,
    "custom_class_queries": custom_class_queries,
    "sub_brand_mentions": sub_brand_mentions,
    "dashboard_totals": dashboard_totals,
    "categories": categories,
    "semi_joined_rates": semi_joined_rates,
}

_EACH = ", ".join(f"CASE WHEN NOT no_map AND c{i} THEN '{c}' END" for i, c in enumerate(COMPETITORS, 1))

ORACLES = {
    "heatmap": cte("sq") + f"SELECT *, {_ZONE} AS zone FROM ({_HEAT})",
    "aivs_global": cte("sq") + f"SELECT {_AIVS} AS aivs FROM sq",
    "global_metrics": cte("sq") + _GLOBAL,
    "competitive_matrix": cte("sq", "mentions") + f"""
SELECT 'target' AS name, true AS is_target, count(*) FILTER (brand_mentioned) AS mentions, {_SOM} AS som, {_RATE} AS mention_rate,
  coalesce(round(sum({_RVS}) FILTER (brand_mentioned) / 100.0::DOUBLE / nullif(count(*) FILTER (brand_mentioned), 0)::DOUBLE, 4), 0.0) AS avg_rvs FROM sq
UNION ALL SELECT competitor, false, count(*), round(count(*) * 100.0::DOUBLE / (SELECT count(*) FILTER (brand_mentioned) + sum({_NAMED}) FROM sq)::DOUBLE, 2), round(count(*)::DOUBLE / (SELECT count(*) FROM sq)::DOUBLE, 4), 0.0
FROM mentions WHERE NOT contains(competitor, '::') GROUP BY competitor""",
    "competitor_counts": cte("mentions") + "SELECT competitor, count(*) AS mentions FROM mentions WHERE NOT contains(competitor, '::') GROUP BY 1",
    "resilience": cte("sq") + _RES,
    "resilience_groups": cte("sq") + "SELECT query_id, provider, count(*) FILTER (brand_mentioned) AS mentioned, count(*) AS total, round(count(*) FILTER (brand_mentioned)::DOUBLE / count(*)::DOUBLE, 4) AS ratio FROM sq GROUP BY ALL",
    "nss": cte("sq") + f"SELECT provider, {_NSS} AS nss FROM sq GROUP BY 1",
    "top1_win_rate": cte("sq") + f"SELECT provider, {_TOP1} AS top1_win_rate FROM sq GROUP BY 1",
    "hallucination_rate": cte("sq") + f"SELECT provider, {_HALL} AS hallucination_rate FROM sq GROUP BY 1",
    "intent_penetration": cte("sq") + f"SELECT query_type, {_AIVS} AS aivs, count(*) AS responses FROM sq GROUP BY 1",
    "citation_graph": cte("cites") + _GRAPH,
    "citations_top": cte("cites") + "SELECT url, count(*) AS citations, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM cites GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "cited_urls_top10": cte("cites") + "SELECT url, count(*) AS citations, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM cites GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "sov_grouping_sets": cte("sq", "mentions") + """, every AS (SELECT provider, 'target' AS name FROM sq WHERE brand_mentioned UNION ALL SELECT provider, competitor FROM mentions WHERE NOT contains(competitor, '::')),
g AS (SELECT coalesce(provider, '*') AS provider, name, count(*) AS mentions FROM every GROUP BY GROUPING SETS ((provider, name), (name)))
SELECT provider, name, mentions, round(mentions::DOUBLE / sum(mentions) OVER (PARTITION BY provider)::DOUBLE, 4) AS share FROM g""",
    "provider_rates": cte("sq") + f"SELECT coalesce(provider, '*') AS provider, count(*) AS checks, count(*) FILTER (brand_mentioned) AS mentions, {_RATE} AS mention_rate, round(coalesce(sum(cost_usd), 0.0), 4) AS cost FROM sq GROUP BY GROUPING SETS ((provider), ())",
    "mention_rate_daily_spine": cte("sq") + f""", w AS (SELECT * FROM sq WHERE day BETWEEN DATE '{ASOF}' - {DAYS} AND DATE '{ASOF}'),
spine AS (SELECT provider, (DATE '{ASOF}' - {DAYS} + i::INT)::DATE AS day FROM (SELECT DISTINCT provider FROM w), range(0, {DAYS + 1}) AS r(i)),
rates AS (SELECT day, provider, {_RATE} AS mention_rate FROM w GROUP BY 1, 2)
SELECT day, provider, mention_rate FROM spine LEFT JOIN rates USING (day, provider)""",
    "advisor_rules": cte("sq", "cites") + f""", h AS ({_HEAT}), m AS ({_GLOBAL}), g AS ({_GRAPH}),
x AS (SELECT m.*, (SELECT count(*) FROM h WHERE aivs < 20) AS red, (SELECT count(DISTINCT provider) FROM h) AS vendors, (SELECT count(DISTINCT provider) FROM h WHERE mention_count > 0) AS seen,
  (SELECT count(*) FROM (SELECT scenario FROM h GROUP BY 1 HAVING bool_and(aivs < 20))) AS dark, (SELECT count(*) FILTER (competitor_win)::DOUBLE / count(*) FROM g) AS wins FROM m)
SELECT 'INVISIBLE_PROBLEM' AS rule_id, 'critical' AS severity FROM x WHERE som = 0 OR aivs < 5
UNION ALL SELECT 'TOXIC_TRAIL', 'critical' FROM x WHERE total_responses > 0 AND mention_rate > 0.3 AND aivs < 30
UNION ALL SELECT 'HEATMAP_RED_ZONE', 'warning' FROM x WHERE red > 0 UNION ALL SELECT 'COMPARATIVE_GAP', 'warning' FROM x WHERE dark > 0
UNION ALL SELECT 'LOCALITY_CURSE', 'warning' FROM x WHERE vendors >= 3 AND seen = 1 UNION ALL SELECT 'CITATION_COMPETITOR_DOMINANCE', 'warning' FROM x WHERE wins > 0.7
UNION ALL SELECT 'LOW_RESILIENCE', 'warning' FROM x WHERE resilience < 0.3 AND mention_rate > 0 UNION ALL SELECT 'HALLUCINATION_RISK', 'info' FROM x WHERE resilience < 0.2 AND aivs > 50""",
    "organic_vs_prompted": cte("sq") + f"SELECT {_PROMPTED} AS prompted, count(*) AS responses, {_RATE} AS mention_rate, {_AIVS} AS aivs FROM sq GROUP BY 1",
    "debug_contributions": cte("sq") + f"SELECT answer_id, query_id, day, provider, {_RVS} / 100.0::DOUBLE AS rvs, {_W} / 10.0::DOUBLE AS weight, round({_RVS} * {_W} / 1000.0::DOUBLE, 4) AS contribution, {_PROMPTED} AS prompted FROM sq",
    "query_stats": cte("q") + f""", x AS (SELECT active, coalesce(query_class, 'unclassified') AS query_class, coalesce(subtype, 'unclassified') AS subtype, {_SCENARIO} AS scenario FROM q)
SELECT 'all' AS kind, '*' AS value, count(*) AS total, count(*) FILTER (active) AS active FROM x UNION ALL SELECT 'class', query_class, count(*), count(*) FILTER (active) FROM x GROUP BY 2
UNION ALL SELECT 'subtype', subtype, count(*), count(*) FILTER (active) FROM x GROUP BY 2 UNION ALL SELECT 'scenario', scenario, count(*), count(*) FILTER (active) FROM x GROUP BY 2""",
    "effective_sentiments": cte("snap") + f"SELECT coalesce({_SENT}, 'skip') AS sentiment, provider, count(*) AS n FROM snap GROUP BY ALL",
    "details_page": cte("sq") + "SELECT answer_id, query_id, day, provider, mention_type, query_text FROM sq WHERE project_id = 2 ORDER BY day DESC, provider, answer_id, query_id LIMIT 20 OFFSET 40",
    "recent_answers": cte("sq") + "SELECT answer_id, day, provider, left(query_text, 80) AS query_text FROM sq ORDER BY day DESC, answer_id DESC, query_id LIMIT 20",
    "export_rows": cte("snap") + f"""SELECT answer_id, query_id, day, provider, CASE WHEN no_map THEN '' ELSE replace(to_json(list_sort(list_filter([{_EACH}], lambda x: x IS NOT NULL)))::VARCHAR, ', ', ',') END AS competitors,
  replace(to_json(list_filter([u1, u2, u3], lambda x: x IS NOT NULL))::VARCHAR, ', ', ',') AS urls, CASE WHEN tokens = 0 THEN '' ELSE tokens::VARCHAR END AS tokens, CASE WHEN cost_usd = 0 THEN '' ELSE printf('%.6f', round(cost_usd, 6)) END AS cost FROM snap""",
    "custom_class_queries": cte("q") + "SELECT query_id, query_class FROM q WHERE query_class NOT IN ('thematic', 'branded')",
    "sub_brand_mentions": cte("mentions") + ", g AS (SELECT string_split(competitor, '::')[1] AS root, competitor, count(*) AS own FROM mentions GROUP BY ALL) SELECT root, competitor, own, (sum(own) OVER (PARTITION BY root))::BIGINT AS with_subs FROM g",
    "dashboard_totals": cte("sq") + f"SELECT project_id, count(DISTINCT CASE WHEN active THEN query_id END) AS active_queries, count(*) AS checks, {_RATE} AS mention_rate, round(coalesce(sum(cost_usd), 0.0), 4) AS cost, max(day) AS last_day FROM sq GROUP BY 1",
    "categories": cte("q") + "SELECT DISTINCT category FROM q WHERE category IS NOT NULL AND category <> ''",
    "semi_joined_rates": cte("snap", "q") + f"SELECT provider, count(*) AS checks, {_RATE} AS mention_rate FROM snap WHERE query_id IN (SELECT query_id FROM q WHERE category ILIKE '%e%' AND active) GROUP BY 1",
}
