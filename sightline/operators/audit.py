"""Bulk page audit over a table of fetched pages, by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Structured-data types that a site should have.
RECOMMENDED_TYPES = ("Organization", "Product", "FAQPage", "HowTo", "Article", "Review", "BreadcrumbList", "WebSite", "LocalBusiness")
# Patterns of phrases that announce a summary.
SUMMARY_PATTERNS = (
    r"tl;?\s*dr",
    r"key\s+takeaway",
    r"in\s+short",
    r"in\s+summary",
    r"quick\s+answer",
    r"short\s+answer",
    r"коротко",
    r"кратко",
    r"итого",
    r"ключевой\s+вывод",
    r"резюме",
)
SUMMARY = "(?iu)" + "|".join(SUMMARY_PATTERNS)


def plain(html: Column) -> Column:
    """Text of a piece of markup: tags out, common references decoded, white space trimmed."""
    t = F.regexp_replace(html, r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def answer_first(pages: DataFrame) -> DataFrame:
    """Title, length of the first paragraph of the main part, summary phrase, and their score."""
    h = F.coalesce("html", F.lit(""))
    part = F.coalesce(F.nullif(F.regexp_extract(h, r"(?is)<main[^>]*>(.*)", 1), F.lit("")), F.nullif(F.regexp_extract(h, r"(?is)<article[^>]*>(.*)", 1), F.lit("")), h)
    first = plain(F.regexp_extract(part, r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</?p[\s>]|</?(?:article|div|footer|body)[\s>]|$)", 1))
    out = pages.withColumns({"title": F.left(plain(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(200)), "first_chars": F.length(first).cast("long"), "has_summary": F.left(plain(h), F.lit(3000)).rlike(SUMMARY)})
    n = F.col("first_chars")
    ladder = F.when(n == 0, 0).when(n < 50, 30).when(n <= 300, 60).when(n <= 500, 40).otherwise(20)
    return out.withColumn("score", (ladder + F.when(F.col("has_summary"), 40).otherwise(0)).cast("double"))


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def signals(pages: DataFrame) -> DataFrame:
    """Authorship, freshness and crawler signals of each page."""
    h = F.coalesce("html", F.lit(""))
    links = F.regexp_extract_all(h, F.lit(r"(?i)<a\s[^>]*href=[\"']?(https?://[^\"'\s>]+)"), F.lit(1))
    own = _host(F.col("url"))
    outside = F.filter(links, lambda u: ~F.coalesce(_host(u) == own, F.lit(False)))
    return pages.select(
        "page_id", h.rlike(r"(?i)rel=[\"']?author|itemprop=[\"']?author|class=[\"'][^\"']*author").alias("has_author"), (F.size(outside) >= 3).alias("has_sources"),
        h.rlike(r"(?i)<meta[^>]+name=[\"']?robots[\"']?[^>]*noindex").alias("noindex"), h.rlike(r"(?i)<time[\s>]|article:published_time|dateModified").alias("has_date"),
        F.size(F.regexp_extract_all(h, F.lit(r"(?i)<script[^>]+ld\+json"), F.lit(0))).cast("long").alias("ld_blocks"), F.regexp_count(h, F.lit(r"(?i)<a[\s>]")).cast("long").alias("links"),
    )


def structured_types(pages: DataFrame) -> DataFrame:
    """(page_id, type) of JSON-LD blocks, arrays and @graph members included."""
    blocks = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<script[^>]+ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    d = pages.select("page_id", F.explode(blocks).alias("b"))
    many = F.coalesce(F.from_json(F.get_json_object("b", "$.@graph"), "array<string>"), F.from_json("b", "array<string>"), F.array("b"))
    one = d.select("page_id", F.explode(many).alias("o"))
    kind = F.get_json_object("o", "$.@type")
    return one.select("page_id", F.coalesce(F.get_json_object(kind, "$[0]"), kind).alias("type")).where("type is not null").distinct()


def site_rollup(pages: DataFrame) -> DataFrame:
    """By site: pages, mean score, structured-data types that are missing."""
    site = _host(F.col("url"))
    scored = answer_first(pages).withColumn("site", site).groupBy("site").agg(F.count("*").alias("pages"), F.round(F.avg("score"), 2).alias("score"))
    found = structured_types(pages).join(pages.select("page_id", site.alias("site")), "page_id").groupBy("site").agg(F.collect_set("type").alias("types"))
    missing = F.array_except(F.array(*map(F.lit, RECOMMENDED_TYPES)), F.coalesce("types", F.array().cast("array<string>")))
    return scored.join(found, "site", "left").select("site", "pages", "score", F.array_join(F.array_sort(missing), ",").alias("missing"))


def bot_access(robots: DataFrame, bots: list[str]) -> DataFrame:
    """(site, bot, allowed) from (site, robots): a bot's own block counts before the wildcard's; the last rule for / decides; null if unmentioned."""
    lines = robots.select("site", F.posexplode(F.split("robots", r"\r?\n")).alias("at", "raw"))
    rule = lines.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*", ""))).withColumns({"key": F.lower(F.trim(F.split("raw", ":", 2)[0])), "value": F.trim(F.get(F.split("raw", ":", 2), F.lit(1)))})
    w = Window.partitionBy("site").orderBy("at")
    agent = F.col("key") == "user-agent"
    r = rule.where("key in ('user-agent', 'allow', 'disallow')").withColumn("starts", agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False)))
    r = r.withColumn("block", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = r.where(agent).select("site", "block", F.lower("value").alias("agent"))
    rules = r.where(~agent & (F.col("value").isin("/", ""))).select("site", "block", "at", F.when(F.col("key") == "allow", F.col("value") == "/").otherwise(F.col("value") == "").alias("allow"))
    verdict = agents.join(rules, ["site", "block"], "left").groupBy("site", "agent").agg(F.max_by("allow", "at").alias("allow"))
    each = robots.select("site", F.explode(F.array(*map(F.lit, bots))).alias("bot"))
    own = verdict.withColumnsRenamed({"site": "own_site", "allow": "own_allow"}).withColumn("has_own", F.lit(True))
    star = verdict.where("agent = '*'").select("site", F.col("allow").alias("star_allow"))
    out = each.join(own, (F.col("site") == F.col("own_site")) & (F.lower("bot") == F.col("agent")), "left").join(star, "site", "left")
    return out.select("site", "bot", F.when(F.col("has_own"), F.col("own_allow")).otherwise(F.col("star_allow")).alias("allowed"))
