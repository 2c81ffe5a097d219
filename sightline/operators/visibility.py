"""Visibility metrics over answer facts: each operator takes DataFrames and returns one lazy plan, with no collect.

Facts have query_id, day, provider, brand_mentioned, mention_type, competitor_mentions, cited_urls, sentiment_label, position_rank,
structure_type, is_hallucination and the query's query_type and category. Metrics are algebraic sums, so they combine before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Visibility of a mention type and weight of a query type, in hundredths and tenths, so that sums are exact.
RVS = {"recommended": 120, "direct": 70, "compared": 50, "negative": 35, "none": 0}
INTENT = {"comparison": 15, "recommendation": 12, "brand_check": 10, "custom": 8}
DEFAULT_INTENT = 8
SENTIMENT_OF = {"recommended": "positive", "negative": "negative", "direct": "neutral", "compared": "neutral"}
RANKED = ("numbered_list", "table", "mixed")


def rvs(mention_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RVS.items() for x in kv])[mention_type], F.lit(0))


def weight(query_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in INTENT.items() for x in kv])[query_type], F.lit(DEFAULT_INTENT))


def aivs() -> Column:
    """min(100 * sum(rvs * w) / sum(w), 100), two digits; 0 without rows."""
    w = weight(F.col("query_type"))
    ratio = F.try_divide(F.sum(rvs(F.col("mention_type")) * w).cast("double"), F.sum(w).cast("double"))
    return F.when(ratio.isNull(), 0.0).otherwise(F.round(F.least(ratio, F.lit(100.0)), 2))


def share(part: Column, whole: Column, digits: int = 4, scale: float = 1.0) -> Column:
    return F.coalesce(F.round(F.try_divide(part.cast("double") * scale, whole.cast("double")), digits), F.lit(0.0))


def mention_rate(digits: int = 4) -> Column:
    return share(F.count_if("brand_mentioned"), F.count("*"), digits)


def effective_sentiment(label: Column, mention_type: Column) -> Column:
    """The label in lower case, else what the mention type implies; null where neither scores."""
    fallback = F.create_map(*[F.lit(x) for kv in SENTIMENT_OF.items() for x in kv])[mention_type]
    s = F.coalesce(F.nullif(F.lower(label), F.lit("")), fallback)
    return F.when(~s.isin("skip", "none"), s)


def nss() -> Column:
    s = effective_sentiment(F.col("sentiment_label"), F.col("mention_type"))
    return share(F.count_if(s == "positive") - F.count_if(s == "negative"), F.count(s), 2, 100.0)


def top1_rate() -> Column:
    """Share of ranked answers with rank 1; null where none is ranked."""
    ranked = F.col("structure_type").isin(*RANKED) & F.col("position_rank").isNotNull()
    return F.round(F.try_divide(F.count_if(ranked & (F.col("position_rank") == 1)) * 100.0, F.count_if(ranked).cast("double")), 2)


def hallucination_rate() -> Column:
    judged = F.col("brand_mentioned") & F.col("is_hallucination").isNotNull()
    return F.round(F.try_divide(F.count_if(judged & F.col("is_hallucination")) * 100.0, F.count_if(judged).cast("double")), 2)


def zone(score: Column) -> Column:
    return F.when(score < 20, "red").when(score < 50, "yellow").otherwise("green")


def scenario() -> Column:
    return F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Uncategorized"))


def window(df: DataFrame, asof: str, days: int) -> DataFrame:
    """Rows of the last days up to asof; the bound is a literal, so it reaches the scan."""
    return df.where(F.col("day").between(F.date_sub(F.lit(asof).cast("date"), days), F.lit(asof).cast("date")))


def heatmap(df: DataFrame) -> DataFrame:
    cells = df.groupBy(scenario().alias("scenario"), "provider").agg(aivs().alias("aivs"), F.count_if("brand_mentioned").alias("mention_count"), F.count("*").alias("total"))
    return cells.withColumn("zone", zone(F.col("aivs")))


def competitor_mentions(df: DataFrame, rolled_up: bool = True) -> DataFrame:
    """df with one row per competitor that an answer names; sub-brand keys (a::b) are rolled up, that is left out."""
    keep = (lambda k, v: v & ~k.contains("::")) if rolled_up else (lambda k, v: v)
    return df.withColumn("competitor", F.explode(F.map_keys(F.map_filter("competitor_mentions", keep))))


def competitor_counts(df: DataFrame) -> DataFrame:
    return competitor_mentions(df).groupBy("competitor").agg(F.count("*").alias("mentions"))


def named(df: DataFrame) -> Column:
    """How many rolled-up competitors an answer names."""
    return F.coalesce(F.size(F.map_filter("competitor_mentions", lambda k, v: v & ~k.contains("::"))), F.lit(0))


def share_of_model(df: DataFrame) -> Column:
    brand = F.count_if("brand_mentioned")
    return share(brand, brand + F.sum(named(df)), 2, 100.0)


def resilience_groups(df: DataFrame) -> DataFrame:
    g = df.groupBy("query_id", "provider").agg(F.count_if("brand_mentioned").alias("mentioned"), F.count("*").alias("total"))
    return g.withColumn("ratio", F.round(F.col("mentioned") / F.col("total"), 4))


def resilience(df: DataFrame) -> DataFrame:
    """Mean of the groups' mention shares: an average of averages, not pooled."""
    g = df.groupBy("query_id", "provider").agg(F.avg(F.col("brand_mentioned").cast("int")).alias("r"))
    return g.agg(F.coalesce(F.round(F.avg("r"), 4), F.lit(0.0)).alias("resilience"))


def global_metrics(df: DataFrame) -> DataFrame:
    """One row: all answer-level metrics in one pass, and resilience from its own grouping."""
    one = df.agg(
        aivs().alias("aivs"), share_of_model(df).alias("som"), mention_rate().alias("mention_rate"), nss().alias("nss"), top1_rate().alias("top1_win_rate"),
        hallucination_rate().alias("hallucination_rate"), F.count("*").alias("total_responses"),
    )
    return one.join(resilience(df))


def intent_penetration(df: DataFrame) -> DataFrame:
    return df.groupBy("query_type").agg(aivs().alias("aivs"), F.count("*").alias("responses"))


def competitive_matrix(df: DataFrame, target: str = "target") -> DataFrame:
    """The target and its competitors: share of all mentions, mention rate, mean visibility of mentioned answers."""
    total = df.agg(F.count("*").alias("responses"), F.count_if("brand_mentioned").alias("brand"), F.sum(named(df)).alias("others"), F.sum(F.when(F.col("brand_mentioned"), rvs(F.col("mention_type")))).alias("rvs"))
    every = total.select("responses", (F.col("brand") + F.col("others")).alias("all_mentions"), "brand", "rvs")
    mine = every.select(F.lit(target).alias("name"), F.lit(True).alias("is_target"), F.col("brand").alias("mentions"), share(F.col("brand"), F.col("all_mentions"), 2, 100.0).alias("som"),
                        share(F.col("brand"), F.col("responses")).alias("mention_rate"), share(F.col("rvs") / 100.0, F.col("brand")).alias("avg_rvs"))
    theirs = competitor_counts(df).join(F.broadcast(every)).select(F.col("competitor").alias("name"), F.lit(False).alias("is_target"), "mentions", share(F.col("mentions"), F.col("all_mentions"), 2, 100.0).alias("som"),
                        share(F.col("mentions"), F.col("responses")).alias("mention_rate"), F.lit(0.0).alias("avg_rvs"))
    return mine.unionByName(theirs)


def netloc(url: Column) -> Column:
    """Authority without a leading www.; port and case are kept."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), r"^www\.", "")


def competitor_win() -> Column:
    """An answer that names a competitor (sub-brands count here) and not the brand."""
    return ~F.col("brand_mentioned") & F.coalesce(F.exists(F.map_values("competitor_mentions"), lambda v: v), F.lit(False))


def citation_graph(df: DataFrame) -> DataFrame:
    c = df.select(F.explode("cited_urls").alias("url"), "provider", competitor_win().alias("win")).withColumn("domain", netloc(F.col("url"))).where("domain is not null")
    return c.groupBy("domain").agg(F.count("*").alias("citations"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.bool_or("win").alias("competitor_win"))


def citations_by_url(df: DataFrame, top: int) -> DataFrame:
    c = df.select(F.explode("cited_urls").alias("url"), "provider").groupBy("url").agg(F.count("*").alias("citations"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
    return c.orderBy(F.desc("citations"), "url").limit(top)


def share_of_voice(df: DataFrame) -> DataFrame:
    """Mentions overall, by provider, by name and by both, each with its own denominator; shares are fractions."""
    brand = df.where("brand_mentioned").select("provider", F.lit("target").alias("name"))
    every = brand.unionByName(competitor_mentions(df).select("provider", F.col("competitor").alias("name")))
    g = every.groupingSets([["provider", "name"], ["name"]], "provider", "name").agg(F.grouping("provider").alias("overall"), F.count("*").alias("mentions"))
    totals = g.groupBy(F.col("provider").alias("p")).agg(F.sum("mentions").alias("n"))
    out = g.join(totals, F.col("provider").eqNullSafe(F.col("p")))
    return out.select(F.coalesce("provider", F.lit("*")).alias("provider"), "name", "mentions", share(F.col("mentions"), F.col("n")).alias("share"))


def provider_rates(df: DataFrame) -> DataFrame:
    """Overall and by provider in one pass."""
    g = df.groupingSets([["provider"], []], "provider").agg(F.count("*").alias("checks"), F.count_if("brand_mentioned").alias("mentions"), mention_rate().alias("mention_rate"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost"))
    return g.withColumn("provider", F.coalesce("provider", F.lit("*")))


def daily_rates(df: DataFrame, asof: str, days: int) -> DataFrame:
    """A row for each day of the window and provider; rate is null on days without answers."""
    w = window(df, asof, days)
    rates = w.groupBy("day", "provider").agg(mention_rate().alias("mention_rate"))
    end = F.lit(asof).cast("date")
    spine = w.select("provider").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(end, days), end)))
    return spine.join(rates, ["day", "provider"], "left")


def advisor(df: DataFrame) -> DataFrame:
    """Rules that fire on the metrics, the heatmap and the citations: (rule_id, severity)."""
    cells = heatmap(df)
    by_scenario = cells.groupBy("scenario").agg(F.bool_and(F.col("aivs") < 20).alias("dark"))
    c = cells.agg(F.count_if(F.col("zone") == "red").alias("red"), F.count_distinct("provider").alias("vendors"), F.count_distinct(F.when(F.col("mention_count") > 0, F.col("provider"))).alias("seen"))
    d = by_scenario.agg(F.count_if("dark").alias("dark"))
    g = citation_graph(df).agg(F.try_divide(F.count_if("competitor_win").cast("double"), F.count("*").cast("double")).alias("wins"))
    m = global_metrics(df).join(c).join(d).join(g)
    rule = lambda name, severity, fires: F.struct(F.lit(name).alias("rule_id"), F.lit(severity).alias("severity"), F.coalesce(fires, F.lit(False)).alias("fires"))
    x = F.col
    rules = F.array(
        rule("INVISIBLE_PROBLEM", "critical", (x("som") == 0) | (x("aivs") < 5)),
        rule("TOXIC_TRAIL", "critical", (x("total_responses") > 0) & (x("mention_rate") > 0.3) & (x("aivs") < 30)),
        rule("HEATMAP_RED_ZONE", "warning", x("red") > 0),
        rule("COMPARATIVE_GAP", "warning", x("dark") > 0),
        rule("LOCALITY_CURSE", "warning", (x("vendors") >= 3) & (x("seen") == 1)),
        rule("CITATION_COMPETITOR_DOMINANCE", "warning", x("wins") > 0.7),
        rule("LOW_RESILIENCE", "warning", (x("resilience") < 0.3) & (x("mention_rate") > 0)),
        rule("HALLUCINATION_RISK", "info", (x("resilience") < 0.2) & (x("aivs") > 50)),
    )
    return m.select(F.explode(F.filter(rules, lambda r: r["fires"])).alias("r")).select("r.rule_id", "r.severity")


def brand_in_prompt() -> Column:
    return F.coalesce(F.lower("query_text").contains(F.lower(F.nullif(F.col("target_brand"), F.lit("")))), F.lit(False))


def organic_vs_prompted(df: DataFrame) -> DataFrame:
    return df.groupBy(brand_in_prompt().alias("prompted")).agg(F.count("*").alias("responses"), mention_rate().alias("mention_rate"), aivs().alias("aivs"))


def contributions(df: DataFrame) -> DataFrame:
    """What each answer adds to the score."""
    r, w = rvs(F.col("mention_type")), weight(F.col("query_type"))
    return df.select("answer_id", "query_id", "day", "provider", (r / 100.0).alias("rvs"), (w / 10.0).alias("weight"), F.round(r * w / 1000.0, 4).alias("contribution"), brand_in_prompt().alias("prompted"))


def query_stats(q: DataFrame) -> DataFrame:
    """Totals, and counts by class, subtype and scenario, in one pass."""
    x = q.select("active", F.coalesce("query_class", F.lit("unclassified")).alias("query_class"), F.coalesce("subtype", F.lit("unclassified")).alias("subtype"), scenario().alias("scenario"))
    g = x.groupingSets([[], ["query_class"], ["subtype"], ["scenario"]], "query_class", "subtype", "scenario").agg(F.grouping_id("query_class", "subtype", "scenario").alias("gid"), F.count("*").alias("total"), F.count_if("active").alias("active"))
    kind = F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "class").when(F.col("gid") == 5, "subtype").otherwise("scenario")
    return g.select(kind.alias("kind"), F.coalesce("query_class", "subtype", "scenario", F.lit("*")).alias("value"), "total", "active")
