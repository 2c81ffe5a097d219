"""Lists and reports of projects: scenarios, entities, keywords, tags and daily collection. Small lists are arrays, everything else is joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope(df: DataFrame, project_id: int | None = None, asof: str | None = None, days: int | None = None, providers: list[str] | None = None, category: str | None = None, tenant: str | None = None) -> DataFrame:
    """Facts of one tenant and project, of the last days, of some providers and of one category; what is None or empty does not bind. All bounds are literals."""
    if tenant is not None:
        df = df.where(F.col("tenant") == tenant)
    if project_id is not None:
        df = df.where(F.col("project_id") == project_id)
    if asof is not None:
        end = F.lit(asof).cast("date")
        df = df.where((F.col("day") <= end) & (F.col("day") >= F.date_sub(end, days)) if days is not None else F.col("day") <= end)
    if providers is not None:
        df = df.where(F.col("provider").isin(*providers))
    return df.where(F.col("category") == category) if category else df


def scenario_tree(scenarios: DataFrame, queries: DataFrame) -> DataFrame:
    """(project_id, name, parent, prompt_count, children, uncategorized): a row for each scenario at the top, its children as an array of structs.

    A scenario whose parent is not at the top stands at the top itself, with its parent's name and without children.
    scenarios (project_id, name, parent), queries (project_id, category).
    """
    n = queries.groupBy("project_id", F.col("category").alias("name")).agg(F.count("*").alias("prompt_count"))
    blank = queries.where(F.coalesce("category", F.lit("")) == "").groupBy("project_id").agg(F.count("*").alias("uncategorized"))
    s = scenarios.join(n, ["project_id", "name"], "left").select("project_id", "name", F.nullif("parent", F.lit("")).alias("parent"), F.coalesce("prompt_count", F.lit(0)).alias("prompt_count"))
    tops = scenarios.where(F.coalesce("parent", F.lit("")) == "").select("project_id", F.col("name").alias("parent")).distinct().withColumn("held", F.lit(True))
    s = s.join(tops, ["project_id", "parent"], "left")
    kids = s.where("held").groupBy("project_id", F.col("parent").alias("name")).agg(F.array_sort(F.collect_list(F.struct("name", "prompt_count"))).alias("children"))
    out = s.where("held is null").join(kids, ["project_id", "name"], "left").join(blank, "project_id", "left")
    none = F.array().cast(kids.schema["children"].dataType)
    return out.select(
        "project_id", "name", "parent", "prompt_count", F.when(F.col("parent").isNull(), F.coalesce("children", none)).otherwise(none).alias("children"), F.coalesce("uncategorized", F.lit(0)).alias("uncategorized")
    )


def breakdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, value, n): rows by the values of each column; null and empty values are passed over."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("x")).select("x.*").where("value <> ''").groupBy("kind", "value").agg(F.count("*").alias("n"))


def landing(queries: DataFrame, snapshots: DataFrame, entities: DataFrame, since: str) -> DataFrame:
    """(project_id, queries, checks, mention_rate, entities) of every project with a query: active queries, their checks since a day, mentions in percent, entities that are no aliases and not rejected."""
    q = queries.groupBy("project_id").agg(F.count_if("active").alias("queries"))
    s = snapshots.where(F.col("day") >= F.lit(since).cast("date")).join(queries.where("active").select("query_id", "project_id"), "query_id")
    s = s.groupBy("project_id").agg(F.count("*").alias("checks"), F.count_if("brand_mentioned").alias("hits"))
    e = entities.where("status <> 'rejected' and alias_of is null").groupBy("project_id").agg(F.count("*").alias("entities"))
    rate = F.coalesce(F.round(F.try_divide(F.col("hits") * 100.0, F.col("checks").cast("double")), 1), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return q.join(s, "project_id", "left").join(e, "project_id", "left").select("project_id", "queries", zero("checks"), rate.alias("mention_rate"), zero("entities"))


def entity_listing(entities: DataFrame, statuses: list[str] | None = None, least: int = 1, suggested_only: bool = False, search: str | None = None) -> DataFrame:
    """Entities with their place in their project's list: most mentions first, then latest seen. Aliases are listed under their parents and not here."""
    d = entities.where("alias_of is null").where(F.col("status").isin(*(statuses or ["pending", "confirmed"]))).where(F.col("mentions") >= least)
    if suggested_only:
        d = d.where("suggested_parent is not null")
    if search:
        d = d.where(F.contains(F.lower("name"), F.lit(search.lower())))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("mentions"), F.desc("last_seen"), "name", "entity_id")))


def page(df: DataFrame, sortable: dict[str, Column], sort: str, descending: bool, key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of a list under a column that may be sorted by; the key decides ties, and an unknown column sorts by the key alone."""
    by = sortable.get(sort, F.col(key))
    return df.orderBy(by.desc() if descending else by.asc(), key).offset(offset).limit(limit)


def tracked(dump: DataFrame, text: str, keywords: DataFrame) -> DataFrame:
    """Rows of a raw dump whose text is a tracked keyword, whatever its case, with keyword_id; of keywords alike the last id counts."""
    k = keywords.groupBy(F.lower("keyword").alias("_k")).agg(F.max("keyword_id").alias("keyword_id"))
    return dump.withColumn("_k", F.lower(text)).join(k, "_k").drop("_k")


def new_tag_links(queries: DataFrame, tags: DataFrame, wanted: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, tag_id) links to add: every query with every wanted tag of its own project, but those that exist. Project lists of tags are short."""
    valid = tags.join(wanted.select("tag_id").distinct(), "tag_id", "left_semi")
    return queries.select("query_id", "project_id").join(valid, "project_id").select("query_id", "tag_id").join(links.select("query_id", "tag_id"), ["query_id", "tag_id"], "left_anti").distinct()


def tag_names(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, place, name) of a JSON array whose members are names or objects with a name; other members have none and go."""
    d = df.select(key, F.posexplode(F.from_json(column, "array<string>")).alias("place", "e"))
    name = F.when(F.col("e").startswith("{"), F.get_json_object("e", "$.name")).otherwise(F.col("e"))
    return d.select(key, "place", name.alias("name")).where("name <> ''")


def latest_page(ranks: DataFrame) -> DataFrame:
    """All rows of each keyword's and engine's latest day, in the order of positions; rows written twice are not merged."""
    last = ranks.groupBy("keyword_id", "engine").agg(F.max("day").alias("day"))
    w = Window.partitionBy("keyword_id", "engine").orderBy(F.asc_nulls_last("position"), "version")
    return ranks.join(last, ["keyword_id", "engine", "day"]).withColumn("place", F.row_number().over(w))


def overlaid(ranks: DataFrame, web: DataFrame) -> DataFrame:
    """(keyword_id, day, type, position): search positions of an engine and the webmaster's mean position as a second series."""
    a = ranks.where("engine = 'google'").groupBy("keyword_id", "day").agg(F.min(F.when(F.col("position") > 0, F.col("position"))).cast("double").alias("position"))
    b = web.groupBy("keyword_id", "day").agg(F.round(F.avg("position"), 2).alias("position"))
    return a.withColumn("type", F.lit("serp")).unionByName(b.withColumn("type", F.lit("webmaster")))


def targets(brands: DataFrame, hierarchy: DataFrame, promoted: DataFrame) -> DataFrame:
    """(project_id, name): brands, competitors and sub-brands (a::b names both) and promoted entities, each once."""
    parts = hierarchy.select("project_id", F.explode(F.split("name", "::")).alias("name"))
    return brands.select("project_id", "name").unionByName(parts).unionByName(promoted.select("project_id", "name")).where("name <> ''").distinct()


def suggestions(candidates: DataFrame, taken: DataFrame, most: int = 10) -> DataFrame:
    """The first so many candidates (project_id, name, rank) of each project, by rank, whose names are not taken, whatever their case."""
    t = taken.select("project_id", F.lower("name").alias("_k")).distinct()
    left = candidates.withColumn("_k", F.lower("name")).join(t, ["project_id", "_k"], "left_anti").drop("_k")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("rank", "name"))
    return left.withColumn("place", place).where(F.col("place") <= most)


def daily_report(keywords: DataFrame, ranks: DataFrame, web: DataFrame, errors: DataFrame, shown: int = 3) -> DataFrame:
    """(project_id, day, serp, webmaster, errors): rows collected, and the first few errors joined by semicolons. errors (keyword_id, day, at, error)."""
    k = keywords.select("keyword_id", "project_id")
    a = ranks.join(k, "keyword_id").groupBy("project_id", "day").agg(F.count("*").alias("serp"))
    b = web.join(k, "keyword_id").groupBy("project_id", "day").agg(F.count("*").alias("webmaster"))
    w = Window.partitionBy("project_id", "day").orderBy("at")
    e = errors.join(k, "keyword_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= shown)
    e = e.groupBy("project_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "error"))), lambda x: x["error"]), ";").alias("errors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, ["project_id", "day"], "full").join(e, ["project_id", "day"], "full").select("project_id", "day", zero("serp"), zero("webmaster"), F.coalesce("errors", F.lit("")).alias("errors"))


def visible(projects: DataFrame, assignments: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Projects that a user may see: all for an administrator, else those assigned."""
    return projects if admin else projects.join(assignments.where(F.col("user") == user).select("project_id"), "project_id", "left_semi")


def sitemap_pages(maps: DataFrame) -> DataFrame:
    """(site, place, url) from (site, xml): addresses of a sitemap that lie on its own site, in order."""
    from sightline.functions.catalog import belongs

    d = maps.select("site", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("place", "url"))
    return d.where(belongs(F.col("url"), F.col("site")))
