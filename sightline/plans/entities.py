"""Queries over names, vectors, pages and prompts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import names as N
from sightline.operators import entities as E
from sightline.operators.graph import connected_components
from sightline.sources.adapters import COMPETITORS, cte, facts
from sightline.sources.tables import table

# expressions that both engines read; four spellings of one name
_NAME = """CASE s_suppkey % 4 WHEN 0 THEN 'Supplier Number ' || CAST((s_suppkey - s_suppkey % 4) * 7919 AS STRING) WHEN 1 THEN 'SUPPLIER number ' || CAST((s_suppkey - s_suppkey % 4) * 7919 AS STRING) || ' LLC'
 WHEN 2 THEN 'Supplier.Number ' || CAST((s_suppkey - s_suppkey % 4) * 7919 AS STRING) ELSE 'Группа Supplier  Number ' || CAST((s_suppkey - s_suppkey % 4) * 7919 AS STRING) END"""
_NAMES = f"SELECT {_NAME} AS name, s_suppkey % 17 + 1 AS freq FROM supplier UNION ALL SELECT p_brand, 1 FROM part UNION ALL SELECT lower(p_brand), 2 FROM part WHERE p_partkey % 3 = 0"


def names(spark, sf_dir):
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return (
        s.selectExpr(f"{_NAME} AS name", "s_suppkey % 17 + 1 AS freq")
        .unionAll(p.selectExpr("p_brand AS name", "CAST(1 AS BIGINT) AS freq"))
        .unionAll(p.where("p_partkey % 3 = 0").selectExpr("lower(p_brand) AS name", "CAST(2 AS BIGINT) AS freq"))
    )


def frequencies(spark, sf_dir):
    return names(spark, sf_dir).groupBy("name").agg(F.sum("freq").alias("freq"))


def name_forms(spark, sf_dir):
    return E.name_forms(names(spark, sf_dir)).select("name", "norm", "lat", "bare")


def name_pairs(spark, sf_dir):
    return E.pairs(E.name_forms(names(spark, sf_dir)))


def name_pairs_exact(spark, sf_dir):
    f = E.name_forms(names(spark, sf_dir)).select("name", "bare").where("bare <> ''")
    return f.select(F.col("name").alias("a"), "bare").join(f.select(F.col("name").alias("b"), "bare"), "bare").where("a < b").select("a", "b")


def _clusters(spark, sf_dir):
    freq = frequencies(spark, sf_dir)
    order = freq.select("name", F.struct((-F.col("freq")).alias("f"), F.col("name").alias("n")).alias("rank"))
    return E.ranked_leaders(E.name_forms(names(spark, sf_dir)), order).join(freq, "name")


def name_links(spark, sf_dir):
    """Every name with its class and the number of other names that it matches."""
    return E.links(E.name_forms(names(spark, sf_dir)))


def name_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("name", "leader", "freq")


def canonical_pick(spark, sf_dir):
    return E.canonical(_clusters(spark, sf_dir)).select("canonical", "total")


def name_components(spark, sf_dir):
    return connected_components(name_pairs_exact(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("members"))


def name_counts(spark, sf_dir):
    return frequencies(spark, sf_dir).orderBy(F.desc("freq"), "name").limit(20)


def vector_pairs(spark, sf_dir):
    """Neighbours of every 50th vector with both labels, of which either may be null: (q, vec_id, distance, same_label)."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    of_q = label.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("ql"))
    d = vector_search(spark, sf_dir).join(label, "vec_id").join(of_q, "q")
    return d.select("q", "vec_id", "distance", F.coalesce(F.col("ql") == F.col("label"), F.lit(False)).alias("same_label"))


def vector_search(spark, sf_dir):
    """Queries (every 50th vector) against all vectors, whatever their label: neighbours within distance 0.6."""
    from sightline.operators.vectors import search

    v = table(spark, sf_dir, "embeddings")
    d = search(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 0.6 + 5e-7).withColumn("distance", F.round("distance", 6) + F.lit(0.0))
    return d.where("distance <= 0.6").select("q", F.col("id").alias("vec_id"), "distance")


def vector_neighbours(spark, sf_dir):
    from sightline.operators.vectors import neighbours

    d = neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.62)
    return d.select("a", "b", F.round("distance", 5).alias("distance"))


def vector_clusters(spark, sf_dir):
    from sightline.operators.vectors import clusters

    return clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.62)


def consolidated_flags(spark, sf_dir):
    """Answer flags rebuilt from the mentions themselves: competitors by name, sub-brands with their parents."""
    from sightline.operators import visibility as V
    from sightline.operators.consolidate import rebuild_flags
    from sightline.sources.adapters import snapshots

    s = snapshots(spark, sf_dir)
    one = s.groupBy("answer_id").agg(F.bool_or("brand_mentioned").alias("b"))
    found = V.competitor_mentions(s, rolled_up=False).select("answer_id", F.col("competitor").alias("key"))
    mine = one.where("b").select("answer_id", F.lit("target").alias("key"))
    known = spark.createDataFrame([(c,) for c in (*COMPETITORS, "target")], "key string")
    out = rebuild_flags(one.select("answer_id"), found.unionByName(mine), known, "target")
    return out.select("answer_id", "brand_mentioned", F.array_join(F.array_sort(F.map_keys(F.map_filter("competitor_mentions", lambda k, v: v))), ",").alias("competitors"))


def vector_means(spark, sf_dir):
    """Mean vector of each label, in long form."""
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return v.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def page_answer_first(spark, sf_dir):
    from sightline.operators.audit import answer_first

    return answer_first(table(spark, sf_dir, "pages")).select("page_id", "title", "first_chars", "has_summary", "score")


def page_flags(spark, sf_dir):
    from sightline.operators.audit import signals

    return signals(table(spark, sf_dir, "pages"))


def site_rollup(spark, sf_dir):
    from sightline.operators.audit import site_rollup as rollup

    return rollup(table(spark, sf_dir, "pages"))


def prompt_matrix(spark, sf_dir):
    from sightline.operators.prompts import matrix

    return matrix(spark, facts(spark, sf_dir, "q")).select("prompt_id", "persona", "intent", "category", "prompt")


def _prompts(spark, sf_dir):
    from sightline.operators.prompts import matrix

    return matrix(spark, facts(spark, sf_dir, "q"))


def prompt_pivots(spark, sf_dir):
    from sightline.operators.prompts import pivots

    return pivots(_prompts(spark, sf_dir))


def prompt_openings(spark, sf_dir):
    from sightline.operators.prompts import conversational

    return conversational(_prompts(spark, sf_dir))


def prompt_requests(spark, sf_dir):
    from sightline.operators.prompts import adapted

    return adapted(_prompts(spark, sf_dir))


def near_dup(spark, sf_dir):
    """Query texts of one project and type whose matching blocks make more than 0.75 of them, each under the first that leads."""
    from sightline.operators.prompts import near_duplicates

    return near_duplicates(facts(spark, sf_dir, "q"), "query_id", "query_text", by=("project_id", "query_type"))


def resilience_expand(spark, sf_dir):
    from sightline.operators.prompts import expand_runs

    return expand_runs(facts(spark, sf_dir, "q").where("active"), 3).select("request_id", "query_id", "run", "session_id")


def tag_links(spark, sf_dir):
    from sightline.operators.prompts import tag_links as links

    return links(facts(spark, sf_dir, "q"))


QUERIES = {
    "name_forms": name_forms,
    "name_pairs": name_pairs,
    "name_pairs_exact": name_pairs_exact,
    "name_links": name_links,
    "name_clusters": name_clusters,
    "name_components": name_components,
    "canonical_pick": canonical_pick,
    "name_counts": name_counts,
    "vector_pairs": vector_pairs,
    "vector_search": vector_search,
    "vector_means": vector_means,
    "vector_neighbours": vector_neighbours,
    "vector_clusters": vector_clusters,
    "consolidated_flags": consolidated_flags,
    "page_answer_first": page_answer_first,
    "page_flags": page_flags,
    "site_rollup": site_rollup,
    "prompt_matrix": prompt_matrix,
    "prompt_pivots": prompt_pivots,
    "prompt_openings": prompt_openings,
    "prompt_requests": prompt_requests,
    "near_dup": near_dup,
    "resilience_expand": resilience_expand,
    "tag_links": tag_links,
}

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.LATIN.items()) + "}"
_norm = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '(\w)\.(\w)', '\1 \2', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"
_lat = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ''), lambda c: coalesce({_MAP}[c], c)), '')"
_bare = lambda x: rf"regexp_replace(regexp_replace(trim({x}), '(?i)^(?:(?:{N.PREFIXES})\s+){{1,4}}', ''), '(?i)\s+(?:{N.SUFFIXES})$', '')"
_FORMS = f"WITH names AS ({_NAMES}), d AS (SELECT DISTINCT name, {_bare('name')} AS b FROM names), forms AS (SELECT name, {_norm('name')} AS norm, {_norm(_lat('name'))} AS lat, {_norm('b')} AS bare FROM d)\n"
_EXACT = "SELECT x.name AS a, y.name AS b FROM forms x JOIN forms y ON x.bare = y.bare AND x.name < y.name AND x.bare <> ''"
_DIST = "round(1 - list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]) * list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[])), 6)"
_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '^\s+|\s+$', '', 'g'))"""
_FIRST = r"""regexp_extract(regexp_extract(html, '(?is)<article[^>]*>(.*)', 1), '(?is)<p(?:\s[^>]*)?>(.*?)(?:</?p[\s>]|</?(?:article|div|footer|body)[\s>]|$)', 1)"""
_PAGE = rf"""WITH a AS (SELECT page_id, url, left({_PLAIN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 200) AS title, length({_PLAIN.format(_FIRST)})::BIGINT AS first_chars,
 regexp_matches(left({_PLAIN.format("html")}, 3000), '(?i)tl;?\s*dr|key\s+takeaway|in\s+short|in\s+summary|quick\s+answer|short\s+answer|коротко|кратко|итого|ключевой\s+вывод|резюме') AS has_summary FROM pages),
s AS (SELECT *, (CASE WHEN first_chars = 0 THEN 0 WHEN first_chars < 50 THEN 30 WHEN first_chars <= 300 THEN 60 WHEN first_chars <= 500 THEN 40 ELSE 20 END + CASE WHEN has_summary THEN 40 ELSE 0 END)::DOUBLE AS score FROM a)
"""
_TYPES = "['Organization', 'Product', 'FAQPage', 'HowTo', 'Article', 'Review', 'BreadcrumbList', 'WebSite', 'LocalBusiness']"
# every string behind an @type, or first in its array, inside JSON-LD blocks
_LD = r""", l AS (SELECT page_id, flatten(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<script[^>]+ld\+json[^>]*>(.*?)</script>', 1), lambda b: regexp_extract_all(b, '"@type"\s*:\s*\[?\s*"([^"]+)"', 1))) AS types FROM pages)
"""
_SITE = r"regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '')"

ORACLES = {
    "name_forms": _FORMS + "SELECT name, norm, lat, bare FROM forms",
    "name_pairs_exact": _FORMS + _EXACT,
    "name_components": _FORMS + f", e AS ({_EXACT}), g AS (SELECT name, bare FROM forms WHERE bare <> '') SELECT component, members FROM (SELECT bare, min(name) AS component, count(*) AS members FROM g GROUP BY 1) WHERE members > 1",
    "name_counts": f"WITH names AS ({_NAMES}) SELECT name, sum(freq)::BIGINT AS freq FROM names GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "vector_pairs": f"SELECT x.vec_id AS q, y.vec_id, {_DIST} AS distance, coalesce(x.label = y.label, false) AS same_label FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0 AND {_DIST} <= 0.6",
    "vector_search": f"SELECT x.vec_id AS q, y.vec_id, {_DIST} AS distance FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0 AND {_DIST} <= 0.6",
    "vector_means": "SELECT label, place, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS place FROM embeddings) GROUP BY ALL",
    "resilience_expand": "SELECT sha256(p_partkey::VARCHAR || '|' || r.i::VARCHAR)[1:16] AS request_id, p_partkey AS query_id, r.i::INT AS run, md5('session|' || p_partkey::VARCHAR)[1:12] AS session_id FROM part, range(0, 3) AS r(i) WHERE p_partkey % 10 <> 0",
    "page_answer_first": _PAGE + "SELECT page_id, title, first_chars, has_summary, score FROM s",
    "site_rollup": _PAGE + _LD + f"SELECT {_SITE} AS site, count(*) AS pages, round(avg(score), 2) AS score, array_to_string(list_sort(list_filter({_TYPES}, lambda k: NOT list_contains(coalesce(flatten(list(types)), []), k))), ',') AS missing FROM s JOIN l USING (page_id) GROUP BY 1",
    "page_flags": r"""SELECT page_id, regexp_matches(html, '(?i)rel=["'']?author|itemprop=["'']?author|class=["''][^"'']*author') AS has_author, len(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']?https?://')) >= 3 AS has_sources,
 regexp_matches(html, '(?i)<meta[^>]+name=["'']?robots["'']?[^>]*noindex') AS noindex, regexp_matches(html, '(?i)<time[\s>]|article:published_time|dateModified') AS has_date,
 len(regexp_extract_all(html, '(?i)<script[^>]+ld\+json'))::BIGINT AS ld_blocks, len(regexp_extract_all(html, '(?i)<a[\s>]'))::BIGINT AS links FROM pages""",
    "tag_links": "WITH l AS (SELECT p_partkey, 'class' AS type, CASE WHEN p_partkey % 3 = 0 THEN 'thematic' WHEN p_partkey % 3 = 1 THEN 'branded' WHEN p_partkey % 6 = 2 THEN 'seasonal' END AS tag FROM part UNION ALL SELECT p_partkey, 'subtype', CASE p_partkey % 4 WHEN 1 THEN 'price' WHEN 2 THEN 'review' WHEN 3 THEN 'howto' END FROM part) SELECT type, tag, count(DISTINCT p_partkey) AS links FROM l WHERE tag IS NOT NULL GROUP BY ALL",
    "prompt_matrix": """WITH c AS (SELECT DISTINCT p_type AS category FROM part WHERE p_partkey % 7 > 1 AND p_type <> ''), g AS (SELECT category, persona, intent, template, competitor FROM c, unnest(['buyer', 'expert', 'novice']) AS p(persona),
 (VALUES ('discovery', 'Which {category} is best for a {persona}?', ''), ('comparison', 'Compare {category} with {competitor} for a {persona}', 'Acme'), ('comparison', 'Compare {category} with {competitor} for a {persona}', 'Globex'), ('price', 'How much does {category} cost?', '')) AS t(intent, template, competitor))
SELECT md5(concat_ws('|', persona, intent, category, competitor))[1:12] AS prompt_id, persona, intent, category, replace(replace(replace(template, '{category}', category), '{persona}', persona), '{competitor}', competitor) AS prompt FROM g""",
    "vector_neighbours": "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), d AS (SELECT x.vec_id AS a, y.vec_id AS b, 1 - list_dot_product(x.e, y.e) / (x.l * y.l) AS d FROM n x JOIN n y ON x.vec_id < y.vec_id) SELECT a, b, round(d, 5) AS distance FROM d WHERE d <= 0.62",
    "consolidated_flags": cte("snap") + f""", k AS (SELECT answer_id, brand_mentioned, unnest(list_distinct(list_filter([{", ".join(f"CASE WHEN NOT no_map AND c{i} THEN '{c}' END" for i, c in enumerate(COMPETITORS, 1))},
 CASE WHEN NOT no_map AND c4 THEN 'Acme' END, CASE WHEN NOT no_map AND c5 THEN 'Globex' END, ''], lambda x: x IS NOT NULL))) AS key FROM snap)
SELECT answer_id, bool_or(brand_mentioned) AS brand_mentioned, coalesce(array_to_string(list_sort(list(DISTINCT key) FILTER (key <> '')), ','), '') AS competitors FROM k GROUP BY 1""",
}
_PROMPTS = "WITH p AS (" + ORACLES["prompt_matrix"] + ") "
ORACLES["prompt_pivots"] = _PROMPTS + r"""SELECT prompt_id, swap, regexp_replace(prompt, '(?i)' || word, swap) AS prompt FROM p, (VALUES ('best', 'most reliable'), ('best', 'cheapest'), ('cost', 'take to set up')) AS s(word, swap) WHERE contains(lower(prompt), word) AND regexp_replace(prompt, '(?i)' || word, swap) <> prompt"""
ORACLES["prompt_openings"] = _PROMPTS + "SELECT prompt_id, opening || lower(left(prompt, 1)) || substr(prompt, 2) AS prompt FROM p, (VALUES ('Hi, '), ('Quick question: '), ('I am new to this. ')) AS o(opening)"
ORACLES["prompt_requests"] = _PROMPTS + "SELECT prompt_id || ':' || assistant AS request_id, assistant, system, prompt FROM p, (VALUES ('chat', 'You are a helpful assistant.'), ('search', 'Answer with sources.'), ('brief', 'Answer in one sentence.')) AS a(assistant, system)"
