"""Queries over projects' lists, texts and addresses, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import catalog as C
from sightline.operators import catalog as O
from sightline.operators import visibility as V
from sightline.plans.visibility import _AIVS, _RATE
from sightline.sources.adapters import COMPETITORS, cte, facts, joined, snapshots
from sightline.sources.tables import table

ASOF, SINCE = "1998-06-30", "1998-05-31"

# expressions that both engines read
_PART = "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END END"
_SPELLED = "CASE p_partkey % 4 WHEN 0 THEN '«' || p_brand || '»' WHEN 1 THEN ' Big' || p_brand || '.Shop ' WHEN 2 THEN 'superShop-' || p_brand ELSE upper(p_name) END"
_TYPED = "CASE c_custkey % 6 WHEN 0 THEN 'https://Shop' || CAST(c_custkey AS STRING) || '.example.com/x?y=1' WHEN 1 THEN 'me@shop.example.com' WHEN 2 THEN ' shop.example.org:8080 ' WHEN 3 THEN 'shop' WHEN 4 THEN '-shop.example.com' ELSE 'a.shop.example.com' END"
_URL = "CASE c_custkey % 5 WHEN 0 THEN 'https://Example.com/a' WHEN 1 THEN 'http://shop.example.com.:80/' WHEN 2 THEN 'https://badexample.com/' WHEN 3 THEN 'example.com' ELSE 'https://example.com.evil.org/' END"
_MONTH = "CASE substr(d, 6, 2) WHEN '01' THEN 'Jan' WHEN '02' THEN 'Feb' WHEN '03' THEN 'Mar' WHEN '04' THEN 'Apr' WHEN '05' THEN 'May' WHEN '06' THEN 'Jun' WHEN '07' THEN 'Jul' WHEN '08' THEN 'Aug' WHEN '09' THEN 'Sep' WHEN '10' THEN 'Oct' WHEN '11' THEN 'Nov' ELSE 'Dec' END"


def scoped_metrics(spark, sf_dir):
    d = joined(spark, sf_dir).withColumn("tenant", F.concat(F.lit("t"), F.col("project_id") % 2))
    d = O.scope(d, project_id=2, asof=ASOF, days=365, providers=["A-F", "N-O"], tenant="t0")
    return d.groupBy("provider").agg(F.count("*").alias("checks"), V.mention_rate().alias("mention_rate"), V.aivs().alias("aivs"))


def scenario_tree(spark, sf_dir):
    q = table(spark, sf_dir, "part").selectExpr("1 + p_size % 4 AS project_id", f"{_PART} AS category", "p_brand", "p_type", "p_partkey")
    top = q.where("p_type <> 'SMALL'").selectExpr("project_id", "p_type AS name", "CAST(NULL AS STRING) AS parent")
    s = top.unionByName(q.groupBy("project_id", F.col("p_brand").alias("name")).agg(F.min("p_type").alias("parent"))).distinct()
    d = O.scenario_tree(s, q.select("project_id", "category"))
    return d.withColumn("children", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["name"], c["prompt_count"].cast("string"))), ","))


def suite_breakdown(spark, sf_dir):
    from sightline.operators.prompts import adapted
    from sightline.plans.entities import _prompts

    p = _prompts(spark, sf_dir)
    return O.breakdown(adapted(p).join(p.select("prompt_id", "persona", "intent", "competitor"), F.split("request_id", ":")[0] == F.col("prompt_id")), ["assistant", "persona", "intent", "competitor"])


def project_landing(spark, sf_dir):
    return O.landing(facts(spark, sf_dir, "q"), snapshots(spark, sf_dir), facts(spark, sf_dir, "ents"), SINCE)


def entity_listing(spark, sf_dir):
    return O.entity_listing(facts(spark, sf_dir, "ents"), least=2, search="er#").select("project_id", "place", "entity_id", "name", "status", "mentions", "last_seen")


def query_page(spark, sf_dir):
    q = facts(spark, sf_dir, "q")
    return O.page(q, {c: F.col(c) for c in ("query_text", "category", "query_class")}, "query_text", True, "query_id", 50, 10).select("query_id", "query_text", "category")


def map_probe(spark, sf_dir):
    has = F.coalesce(F.try_element_at("competitor_mentions", F.lit("Acme")), F.lit(False))
    return snapshots(spark, sf_dir).groupBy("provider").agg(F.count_if(has).alias("named"), F.count("*").alias("n"))


def brand_filters(spark, sf_dir):
    """Thematic queries without any known brand, branded ones with their own."""
    q = facts(spark, sf_dir, "q")
    text, own = F.lower("query_text"), F.coalesce(F.contains(F.lower("query_text"), F.lower("target_brand")), F.lit(False))
    known = F.exists(F.array(F.lit("brand#1"), F.lit("acme")), lambda b: F.contains(text, b))
    keep = F.when(F.col("query_class") == "thematic", ~own & ~known).when(F.col("query_class") == "branded", own).otherwise(True)
    return q.where(keep).select("query_id", "query_class", C.query_type(F.col("subtype"), F.col("query_class")).alias("mapped_type"))


def domain_checks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_TYPED} AS typed", f"{_URL} AS url")
    return c.select("c_custkey", C.bare_domain(F.col("typed")).alias("domain"), C.belongs(F.col("url"), F.lit("Example.com.")).alias("inside"))


def visible_projects(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 3 = 0").selectExpr("'u' || CAST(c_custkey % 5 AS STRING) AS user", "c_nationkey AS project_id")
    return O.visible(facts(spark, sf_dir, "kw").groupBy("project_id").agg(F.count("*").alias("keywords")), a, "u1")


def tracked_dump(spark, sf_dir):
    dump = facts(spark, sf_dir, "web").selectExpr("'CUSTOMER#' || lpad(CAST(keyword_id AS STRING), 9, '0') AS phrase", "clicks", "impressions")
    return O.tracked(dump, "phrase", facts(spark, sf_dir, "kw")).groupBy("keyword_id").agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


def new_tag_links(spark, sf_dir):
    tags = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS tag_id", "1 + n_nationkey % 4 AS project_id")
    q = facts(spark, sf_dir, "q")
    links = q.join(tags, "project_id").where("query_id % 5 = tag_id % 5").select("query_id", "tag_id")
    return O.new_tag_links(q, tags, tags.where("tag_id % 3 = 0"), links)


def tag_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", """CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE '[{"name":"' || p_type || '","x":1},"' || p_brand || '",{"y":2}]' END AS tags""")
    return O.tag_names(p, "p_partkey", "tags")


def rank_page(spark, sf_dir):
    return O.latest_page(facts(spark, sf_dir, "ranks")).select("keyword_id", "engine", "day", "position", "found_url", "place")


def chart_overlay(spark, sf_dir):
    return O.overlaid(facts(spark, sf_dir, "ranks"), facts(spark, sf_dir, "web"))


def promoted_targets(spark, sf_dir):
    q = facts(spark, sf_dir, "q")
    h = table(spark, sf_dir, "part").selectExpr("1 + p_size % 4 AS project_id", "p_brand || '::' || p_type AS name")
    return O.targets(q.select("project_id", F.coalesce("target_brand", F.lit("")).alias("name")), h, facts(spark, sf_dir, "ents").where("status = 'promoted'"))


def merged_competitors(spark, sf_dir):
    own = F.array_compact(F.array("target_brand", F.lit("Acme"), F.when(F.col("active"), F.lit("Initech"))))
    return facts(spark, sf_dir, "q").select("query_id", F.array_join(F.array_union(F.array(*map(F.lit, COMPETITORS[:3])), own), ",").alias("competitors"))


def found_urls(spark, sf_dir):
    r, w = facts(spark, sf_dir, "ranks").select("keyword_id", F.col("found_url").alias("url")), facts(spark, sf_dir, "web").select("keyword_id", F.col("page_url").alias("url"))
    return r.unionByName(w).where("url is not null").distinct()


def cited_domains(spark, sf_dir):
    """Domains that an answer cites, in order, each once."""
    host = lambda u: F.regexp_replace(C.host(u), r"^www\.", "")
    return snapshots(spark, sf_dir).select("answer_id", "query_id", "day", F.array_join(F.array_distinct(F.transform("cited_urls", host)), ",").alias("domains"))


def entity_suggestions(spark, sf_dir):
    e = facts(spark, sf_dir, "ents")
    return O.suggestions(e.select("project_id", "name", (-F.col("mentions")).alias("rank")), e.where("status in ('promoted', 'rejected')"), 10).select("project_id", "name", "place")


def daily_report(spark, sf_dir):
    failed = facts(spark, sf_dir, "ranks").where("position is null").selectExpr("keyword_id", "day", "version AS at", "'e' || CAST(version AS STRING) AS error")
    return O.daily_report(facts(spark, sf_dir, "kw"), facts(spark, sf_dir, "ranks"), facts(spark, sf_dir, "web"), failed)


def webmaster_history(spark, sf_dir):
    w = facts(spark, sf_dir, "web").groupBy("keyword_id", "day").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.round(F.avg("position"), 1).alias("position"))
    return w.withColumn("ctr", F.round(F.try_divide(F.col("clicks") * 100.0, F.col("impressions").cast("double")), 2)).orderBy("keyword_id", F.desc("day"))


def history_ttl(spark, sf_dir):
    """Rows younger than two years, by provider."""
    return snapshots(spark, sf_dir).where(F.col("day") >= F.add_months(F.lit(ASOF).cast("date"), -24)).groupBy("provider").agg(F.count("*").alias("n"))


def name_aliases(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SPELLED} AS name")
    n = F.col("name")
    return p.select("p_partkey", C.mention_key(n).alias("key"), C.unquoted(n).alias("bare"), F.array_join(C.aliases(n), "|").alias("aliases"), C.other_script(F.regexp_replace("name", "[^A-Za-z ]", "")).alias("other"))


def name_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SPELLED} AS name")
    return p.select("p_partkey", C.looked_up(F.col("name"), ["Brand#1", "Brand#13", "BigBrand#2", "Cold Widget"]).alias("known"))


def normal_texts(spark, sf_dir):
    """Every text with its umlauts taken apart, then normalised again."""
    t = F.coalesce("text", F.lit(""))
    t = F.replace(F.replace(t, F.lit("ä"), F.lit("a\u0308")), F.lit("ö"), F.lit("o\u0308"))
    n = C.normal_text(F.concat(F.lit(" \n"), t, F.lit("\t")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n.cast("binary")).alias("md5"), F.length(n).cast("long").alias("n_chars"))


def whole_sentences(spark, sf_dir):
    s = C.whole_sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(s).cast("long").alias("n_chars"))


def freshness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS d").withColumn("m", F.expr(_MONTH))
    http = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Mon, "), F.substr("d", F.lit(9), F.lit(2)), F.lit(" "), F.col("m"), F.lit(" "), F.left("d", F.lit(4)), F.lit(" 23:30:00 GMT")))
    iso = F.when(F.col("o_orderkey") % 4 == 1, F.concat("d", F.lit("T23:30:00+0200"))).when(F.col("o_orderkey") % 4 == 2, F.concat("d", F.lit("T23:30:00Z")))
    day = F.when(F.col("o_orderkey") % 5 < 2, F.concat("d", F.lit(" "))).otherwise("last week")
    return o.select("o_orderkey", C.freshness_days([http, iso, day], F.lit("1999-01-01 00:00:00").cast("timestamp")).alias("days"))


def profile_marks(spark, sf_dir):
    e = facts(spark, sf_dir, "ents")
    text = C.profile_text(F.col("name"), F.coalesce("suggested_parent", F.lit("")), F.col("status"))
    old = F.when(F.col("entity_id") % 2 == 0, C.text_mark(text)).when(F.col("entity_id") % 3 == 0, "0123456789abcdef")
    return e.select("entity_id", text.alias("profile"), C.text_mark(text).alias("mark"), F.coalesce(old != C.text_mark(text), F.lit(True)).alias("stale"))


def sitemap_pages(spark, sf_dir):
    """Addresses of a small sitemap of each page."""
    p = table(spark, sf_dir, "pages").select(C.host(F.col("url")).alias("site"), F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url><url><loc>http://elsewhere.test/</loc></url></urlset>")).alias("xml"))
    return O.sitemap_pages(p)


QUERIES = {
    f.__name__: f
    for f in (
        scoped_metrics, scenario_tree, suite_breakdown, project_landing, entity_listing, query_page, map_probe, brand_filters, domain_checks, visible_projects, tracked_dump, new_tag_links, tag_names, rank_page,
        chart_overlay, promoted_targets, merged_competitors, found_urls, cited_domains, entity_suggestions, daily_report, webmaster_history, history_ttl, name_aliases, name_lookup, normal_texts, whole_sentences, freshness,
        profile_marks, sitemap_pages,
    )
}

_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
_HOST = r"regexp_replace(lower(regexp_extract({}, '://([^/?#:]+)', 1)), '^www\.', '')"

ORACLES = {
    "scoped_metrics": cte("sq") + f"SELECT provider, count(*) AS checks, {_RATE} AS mention_rate, {_AIVS} AS aivs FROM sq WHERE project_id = 2 AND day BETWEEN DATE '{ASOF}' - 365 AND DATE '{ASOF}' AND provider IN ('A-F', 'N-O') AND 't' || (project_id % 2)::VARCHAR = 't0' GROUP BY 1",
    "scenario_tree": f"""WITH q AS (SELECT 1 + p_size % 4 AS project_id, {_PART} AS category, p_brand, p_type FROM part), n AS (SELECT project_id, category, count(*) AS c FROM q GROUP BY ALL),
tops AS (SELECT DISTINCT project_id, p_type AS name FROM q WHERE p_type <> 'SMALL'), kids AS (SELECT project_id, p_brand AS name, min(p_type) AS parent FROM q GROUP BY 1, 2),
k AS (SELECT kids.*, coalesce((SELECT c FROM n WHERE n.project_id = kids.project_id AND n.category = kids.name), 0) AS c, EXISTS (SELECT 1 FROM tops t WHERE t.project_id = kids.project_id AND t.name = kids.parent) AS held FROM kids),
t AS (SELECT project_id, name, NULL AS parent, coalesce((SELECT c FROM n WHERE n.project_id = tops.project_id AND n.category = tops.name), 0) AS prompt_count,
 coalesce((SELECT string_agg(k.name || ':' || k.c, ',' ORDER BY k.name) FROM k WHERE held AND k.project_id = tops.project_id AND k.parent = tops.name), '') AS children FROM tops
 UNION ALL SELECT project_id, name, parent, c, '' FROM k WHERE NOT held)
SELECT *, coalesce((SELECT sum(c)::BIGINT FROM n WHERE n.project_id = t.project_id AND coalesce(category, '') = ''), 0) AS uncategorized FROM t""",
    "project_landing": cte("sq", "ents") + f"""SELECT project_id, queries, coalesce(checks, 0) AS checks, coalesce(rate, 0.0) AS mention_rate, coalesce(e, 0) AS entities FROM (SELECT project_id, count(*) FILTER (active) AS queries FROM q GROUP BY 1)
LEFT JOIN (SELECT project_id, count(*) AS checks, round(count(*) FILTER (brand_mentioned) * 100.0::DOUBLE / count(*)::DOUBLE, 1) AS rate FROM sq WHERE active AND day >= DATE '{SINCE}' GROUP BY 1) USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS e FROM ents WHERE status <> 'rejected' AND alias_of IS NULL GROUP BY 1) USING (project_id)""",
    "entity_listing": cte("ents") + "SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY mentions DESC, last_seen DESC, name, entity_id)::INT AS place, entity_id, name, status, mentions, last_seen FROM ents WHERE alias_of IS NULL AND status IN ('pending', 'confirmed') AND mentions >= 2 AND name ILIKE '%er#%'",
    "query_page": cte("q") + "SELECT query_id, query_text, category FROM q ORDER BY query_text DESC, query_id LIMIT 50 OFFSET 10",
    "map_probe": cte("snap") + "SELECT provider, count(*) FILTER (NOT no_map AND c1) AS named, count(*) AS n FROM snap GROUP BY 1",
    "brand_filters": cte("q") + """, x AS (SELECT *, coalesce(contains(lower(query_text), lower(target_brand)), false) AS own, regexp_matches(lower(query_text), 'brand#1|acme') AS known FROM q)
SELECT query_id, query_class, CASE WHEN query_class IN ('thematic', 'branded') THEN 'brand_check' ELSE 'custom' END AS mapped_type FROM x WHERE CASE query_class WHEN 'thematic' THEN NOT own AND NOT known WHEN 'branded' THEN own ELSE true END""",
    "domain_checks": f"SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Shop' || c_custkey::VARCHAR || '.example.com' WHEN 2 THEN 'shop.example.org' WHEN 5 THEN 'a.shop.example.com' END AS domain, regexp_matches(lower({_URL}), '://([a-z0-9-]+[.])*example[.]com[.]?(:[0-9]+)?(/|$)') AS inside FROM customer",
    "visible_projects": cte("kw") + "SELECT project_id, count(*) AS keywords FROM kw WHERE project_id IN (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 = 1) GROUP BY 1",
    "tracked_dump": cte("web", "kw") + ", k AS (SELECT lower(keyword) AS w, max(keyword_id) AS keyword_id FROM kw GROUP BY 1) SELECT k.keyword_id, count(*) AS n, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions FROM web JOIN k ON 'customer#' || lpad(web.keyword_id::VARCHAR, 9, '0') = w GROUP BY 1",
    "new_tag_links": cte("q") + "SELECT DISTINCT query_id, n_nationkey AS tag_id FROM q JOIN nation ON 1 + n_nationkey % 4 = project_id WHERE n_nationkey % 3 = 0 AND query_id % 5 <> n_nationkey % 5",
    "tag_names": "SELECT p_partkey, 0::INT AS place, p_type AS name FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, 1, p_brand FROM part WHERE p_partkey % 9 <> 0",
    "rank_page": cte("ranks") + ", l AS (SELECT * FROM ranks QUALIFY day = max(day) OVER (PARTITION BY keyword_id, engine)) SELECT keyword_id, engine, day, position, found_url, row_number() OVER (PARTITION BY keyword_id, engine ORDER BY position NULLS LAST, version)::INT AS place FROM l",
    "chart_overlay": cte("ranks", "web") + "SELECT keyword_id, day, 'serp' AS type, min(CASE WHEN position > 0 THEN position END)::DOUBLE AS position FROM ranks WHERE engine = 'google' GROUP BY 1, 2 UNION ALL SELECT keyword_id, day, 'webmaster', round(avg(position), 2) FROM web GROUP BY 1, 2",
    "promoted_targets": cte("q", "ents") + "SELECT DISTINCT * FROM (SELECT project_id, target_brand AS name FROM q UNION ALL SELECT 1 + p_size % 4, p_brand FROM part UNION ALL SELECT 1 + p_size % 4, p_type FROM part UNION ALL SELECT project_id, name FROM ents WHERE status = 'promoted') WHERE name <> ''",
    "merged_competitors": cte("q") + "SELECT query_id, concat_ws(',', 'Acme', 'Globex', 'Initech', CASE WHEN target_brand NOT IN ('Acme', 'Globex', 'Initech') THEN target_brand END) AS competitors FROM q",
    "found_urls": cte("ranks", "web") + "SELECT keyword_id, found_url AS url FROM ranks WHERE found_url IS NOT NULL UNION SELECT keyword_id, page_url FROM web",
    "cited_domains": cte("snap") + f", h AS (SELECT *, {_HOST.format('u1')} AS a, {_HOST.format('u2')} AS b, {_HOST.format('u3')} AS c FROM snap) SELECT answer_id, query_id, day, concat_ws(',', a, CASE WHEN b IS DISTINCT FROM a THEN b END, CASE WHEN c IS DISTINCT FROM a AND c IS DISTINCT FROM b THEN c END) AS domains FROM h",
    "entity_suggestions": cte("ents") + ", l AS (SELECT project_id, name, mentions FROM ents e WHERE NOT EXISTS (SELECT 1 FROM ents t WHERE t.project_id = e.project_id AND lower(t.name) = lower(e.name) AND t.status IN ('promoted', 'rejected'))) SELECT project_id, name, row_number() OVER (PARTITION BY project_id ORDER BY mentions DESC, name)::INT AS place FROM l QUALIFY place <= 10",
    "daily_report": cte("kw", "ranks", "web") + """, a AS (SELECT project_id, day, count(*) AS serp FROM ranks JOIN kw USING (keyword_id) GROUP BY 1, 2), b AS (SELECT project_id, day, count(*) AS webmaster FROM web JOIN kw USING (keyword_id) GROUP BY 1, 2),
f AS (SELECT project_id, day, version FROM ranks JOIN kw USING (keyword_id) WHERE position IS NULL QUALIFY row_number() OVER (PARTITION BY project_id, day ORDER BY version) <= 3), e AS (SELECT project_id, day, string_agg('e' || version, ';' ORDER BY version) AS errors FROM f GROUP BY 1, 2)
SELECT project_id, day, coalesce(serp, 0) AS serp, coalesce(webmaster, 0) AS webmaster, coalesce(errors, '') AS errors FROM a FULL JOIN b USING (project_id, day) FULL JOIN e USING (project_id, day)""",
    "webmaster_history": cte("web") + "SELECT keyword_id, day, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, round(avg(position), 1) AS position, round(sum(clicks) * 100.0::DOUBLE / nullif(sum(impressions), 0)::DOUBLE, 2) AS ctr FROM web GROUP BY 1, 2",
    "history_ttl": cte("snap") + f"SELECT provider, count(*) AS n FROM snap WHERE day >= DATE '{ASOF}' - INTERVAL 24 MONTHS GROUP BY 1",
    "name_aliases": f"""WITH p AS (SELECT p_partkey, {_SPELLED} AS name, p_brand, p_name FROM part), w AS (SELECT *, regexp_replace(name, '[^A-Za-z ]', '', 'g') AS latin FROM p)
SELECT p_partkey, replace(trim(lower(name)), '.', '') AS key, trim(trim(lower(name)), '«»"''') AS bare,
 CASE p_partkey % 4 WHEN 0 THEN lower(name) WHEN 1 THEN concat_ws('|', lower(name), ' big brand#' || substr(p_brand, 7) || '.shop ', ' Big' || p_brand || ' Shop ', ' big' || lower(p_brand) || ' shop ')
  WHEN 2 THEN concat_ws('|', lower(name), 'super shop-' || lower(p_brand), 'superShop ' || p_brand, 'supershop ' || lower(p_brand)) ELSE lower(name) END AS aliases, {{}} AS other FROM w""",
    "name_lookup": f"""WITH p AS (SELECT p_partkey, trim(trim(lower({_SPELLED})), '«»"''') AS n FROM part) SELECT p_partkey, CASE WHEN n = 'brand#1' THEN 'Brand#1' WHEN n = 'brand#13' THEN 'Brand#13' WHEN n = 'bigbrand#2' THEN 'BigBrand#2' WHEN n = 'cold widget' THEN 'Cold Widget'
 WHEN contains('brand#1', n) OR contains(n, 'brand#1') THEN 'Brand#1' WHEN contains('brand#13', n) OR contains(n, 'brand#13') THEN 'Brand#13' WHEN contains('bigbrand#2', n) OR contains(n, 'bigbrand#2') THEN 'BigBrand#2' WHEN contains('cold widget', n) OR contains(n, 'cold widget') THEN 'Cold Widget' END AS known FROM p""",
    "normal_texts": f"WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(replace(replace(coalesce(text, ''), 'ä', 'a' || chr(776)), 'ö', 'o' || chr(776))), '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM n",
    "whole_sentences": rf"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT *, regexp_extract(text, '(?s)^(.*[.!?…])', 1) AS cut FROM d) SELECT doc_id, length(CASE WHEN regexp_matches(text, '[.!?…]{_WS}*\z') OR length(cut) < 2 THEN text ELSE cut END) AS n_chars FROM c",
    "freshness": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS d FROM orders), t AS (SELECT o_orderkey, greatest(CASE WHEN o_orderkey % 3 = 0 THEN d + INTERVAL '23:30:00' END, CASE o_orderkey % 4 WHEN 1 THEN d + INTERVAL '21:30:00' WHEN 2 THEN d + INTERVAL '23:30:00' END, CASE WHEN o_orderkey % 5 < 2 THEN d END) AS t FROM o)
SELECT o_orderkey, CASE WHEN t IS NOT NULL THEN greatest(0, floor(epoch_us(TIMESTAMP '1999-01-01' - t) / 86400000000.0)::BIGINT) END AS days FROM t""",
    "profile_marks": cte("ents") + ", t AS (SELECT *, concat_ws(' | ', name, suggested_parent, status) AS profile FROM ents) SELECT entity_id, profile, sha256(profile)[1:16] AS mark, entity_id % 2 <> 0 AS stale FROM t",
    "sitemap_pages": "SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS site, 0::INT AS place, url FROM pages",
}
# names hold ASCII letters and blanks only once cleaned, so their other form is spelled by the letters' table
_STEPS = "w.latin"
for _l, _c in C.N.CYRILLIC.items():
    _STEPS = f"replace({_STEPS}, '{_l}', '{_c}')"
ORACLES["name_aliases"] = ORACLES["name_aliases"].format("CASE WHEN regexp_matches(w.latin, '[A-Za-z]') THEN " + _STEPS.replace("w.latin", "lower(w.latin)") + " END")
ORACLES["suite_breakdown"] = """WITH c AS (SELECT count(DISTINCT p_type) AS n FROM part WHERE p_partkey % 7 > 1 AND p_type <> '') SELECT kind, value, (n * k)::BIGINT AS n FROM c, (VALUES ('assistant', 'chat', 12), ('assistant', 'search', 12), ('assistant', 'brief', 12),
 ('persona', 'buyer', 12), ('persona', 'expert', 12), ('persona', 'novice', 12), ('intent', 'discovery', 9), ('intent', 'comparison', 18), ('intent', 'price', 9), ('competitor', 'Acme', 9), ('competitor', 'Globex', 9)) AS v(kind, value, k)"""
