"""Queries over assembled answers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import text as T
from sightline.operators.answers import analyze, token_cost
from sightline.sources.adapters import facts
from sightline.sources.tables import table

BRAND = "Brand#1"

_BODY = """p_brand || CASE (l_linenumber + l_partkey) % 5 WHEN 0 THEN ' is the **best choice**, reliable and fast' WHEN 1 THEN ' is expensive and slow, a problem' WHEN 2 THEN ' compared with others: price at [shop](https://www.shop'
 || CAST(l_suppkey % 9 AS STRING) || '.example.com/a)' WHEN 3 THEN '; see https://docs' || CAST(l_partkey % 6 AS STRING) || '.example.org/x.' ELSE ' has support and an API' END"""
_LINES = f"SELECT l_orderkey AS answer_id, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS d, {_BODY} AS body FROM lineitem JOIN part ON l_partkey = p_partkey"
_TEXT = """CASE answer_id % 4 WHEN 0 THEN CAST(n AS STRING) || '. ' || body WHEN 1 THEN '- ' || body WHEN 2 THEN body || '.' ELSE '| ' || body || ' | x |' END"""
_HEAD = "CASE answer_id % 23 WHEN 0 THEN '<think>hm</think>' WHEN 1 THEN '[BLOCKED]' WHEN 2 THEN 'I am an AI. This is not legal advice. ' WHEN 3 THEN '| name | v |\n|---|---|\n' ELSE '' END"
_ANS = f"""lines AS ({_LINES}), numbered AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY a, b, c, d, body) AS n FROM lines),
ans AS (SELECT answer_id, {_HEAD} || CASE WHEN answer_id % 4 = 2 THEN string_agg({_TEXT}, ' ' ORDER BY n) ELSE string_agg({_TEXT}, E'\\n' ORDER BY n) END AS text FROM numbered GROUP BY answer_id)"""


def answers(spark, sf_dir):
    """(answer_id, text): one text an order, its lines as list items, table rows or sentences."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x = l.join(p, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS answer_id", "l_linenumber AS a", "l_partkey AS b", "l_suppkey AS c", "l_extendedprice AS d", f"{_BODY} AS body")
    g = x.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "c", "d", "body"))).alias("rows"))
    kind = F.col("answer_id") % 4
    line = lambda r, i: (
        F.when(kind == 0, F.concat((i + 1).cast("string"), F.lit(". "), r["body"])).when(kind == 1, F.concat(F.lit("- "), r["body"])).when(kind == 2, F.concat(r["body"], F.lit("."))).otherwise(F.concat(F.lit("| "), r["body"], F.lit(" | x |")))
    )
    joined = F.when(kind == 2, F.array_join(F.transform("rows", line), " ")).otherwise(F.array_join(F.transform("rows", line), "\n"))
    return g.select("answer_id", F.concat(F.expr(_HEAD.replace("\n", "\\n")), joined).alias("text"))


def analyzed(spark, sf_dir):
    return analyze(answers(spark, sf_dir), F.lit(BRAND))


def sanitize_flags(spark, sf_dir):
    return analyzed(spark, sf_dir).select("answer_id", "flag", F.length("clean").cast("long").alias("clean_chars"))


def structure_type(spark, sf_dir):
    return analyzed(spark, sf_dir).groupBy("structure").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items"))


def list_items(spark, sf_dir):
    return analyzed(spark, sf_dir).where("structure = 'numbered_list'").select("answer_id", F.posexplode_outer("items").alias("place", "item")).where("item is not null").withColumn("place", F.col("place").cast("long"))


def mention_offsets(spark, sf_dir):
    return analyzed(spark, sf_dir).select("answer_id", "at", "sentence", "mention_type", "rank")


def lexicon(spark, sf_dir):
    d = answers(spark, sf_dir).select("answer_id", T.lexicon_score(F.col("text")).alias("score"), F.array_join(T.tags(F.col("text")), ",").alias("tags"))
    return d.withColumn("label", T.sentiment(F.col("score")))  # a column, as the label names the score more than once


def citations_extract(spark, sf_dir):
    d = answers(spark, sf_dir).select("answer_id", F.explode(T.citations(F.col("text"), F.array().cast("array<string>"))).alias("url"))
    return d.groupBy("url", T.host(F.col("url")).alias("domain")).agg(F.count("*").alias("answers"))


def rvs_scores(spark, sf_dir):
    return analyzed(spark, sf_dir).where("at >= 0").groupBy("structure", "mention_type", "label").agg(F.count("*").alias("n"), F.round(F.sum("rvs"), 2).alias("rvs"))


def token_costs(spark, sf_dir):
    c = facts(spark, sf_dir, "calls")
    prices = spark.createDataFrame([("v0", 2.5, 10.0), ("v1", 0.15, 0.6), ("v2", 1.0, 1.0)], "vendor string, pin double, pout double")
    d = c.join(F.broadcast(prices), "vendor", "left")
    cost = token_cost(F.col("tokens"), F.col("latency_ms"), F.coalesce("pin", F.lit(1.0)), F.coalesce("pout", F.lit(2.0)))
    return d.groupBy("vendor").agg(F.count("*").alias("calls"), F.round(F.sum(cost), 4).alias("cost"))


QUERIES = {
    "sanitize_flags": sanitize_flags,
    "structure_type": structure_type,
    "list_items": list_items,
    "mention_offsets": mention_offsets,
    "lexicon_sentiment": lexicon,
    "citations_extract": citations_extract,
    "rvs_scores": rvs_scores,
    "token_cost": token_costs,
}

_PRE = f"""WITH {_ANS}, body AS (SELECT *, CASE WHEN contains(text, '<think>') THEN trim(replace(text, '<think>hm</think>', '')) ELSE text END AS t FROM ans),
f AS (SELECT *, CASE WHEN contains(text, '[BLOCKED]') THEN 'censored' WHEN contains(text, 'I am an AI. This is not legal advice') THEN 'vendor_refusal' WHEN contains(text, '<think>') THEN 'think_stripped' ELSE 'clean' END AS flag FROM body),
cl AS (SELECT *, CASE flag WHEN 'censored' THEN '' WHEN 'vendor_refusal' THEN t ELSE trim(replace(t, '**', '')) END AS clean FROM f),
st AS (SELECT *, len(regexp_extract_all(clean, '(?m)^[0-9]+\\. .+$')) AS nn, len(regexp_extract_all(clean, '(?m)^- .+$')) AS nb, len(regexp_extract_all(clean, '(?m)^\\|.+\\|$')) AS nr, len(regexp_extract_all(clean, '(?m)^\\|[-|]+\\|$')) AS ns FROM cl),
s AS (SELECT *, CASE WHEN nn >= 2 THEN 'numbered_list' WHEN nb >= 2 THEN 'bulleted_list' WHEN nr >= 2 AND ns >= 1 THEN 'table' ELSE 'narrative' END AS structure FROM st)"""
_PREFIX = "regexp_extract(lower(clean), '(?s)^((?:.*?[^а-яёa-z0-9])??)brand#1(?:[^а-яёa-z0-9]|$)', 1)"
_HAS = "regexp_matches(lower(clean), '(?:^|[^а-яёa-z0-9])brand#1(?:[^а-яёa-z0-9]|$)')"
_GOODS, _BADS = (", ".join(f"'{w}'" for w in ws) for ws in (T.GOOD, T.BAD))

ORACLES = {
    "sanitize_flags": _PRE + "SELECT answer_id, flag, length(clean)::BIGINT AS clean_chars FROM s",
    "structure_type": _PRE + "SELECT structure, count(*) AS n, sum(CASE structure WHEN 'numbered_list' THEN nn WHEN 'bulleted_list' THEN nb WHEN 'table' THEN nr - ns ELSE 0 END)::BIGINT AS items FROM s GROUP BY 1",
    "list_items": _PRE + ", i AS (SELECT answer_id, unnest(list_transform(regexp_extract_all(clean, '(?m)^([0-9]+)\\. (.+)$', 2), lambda x: trim(x))) AS item, generate_subscripts(regexp_extract_all(clean, '(?m)^([0-9]+)\\. (.+)$', 2), 1) - 1 AS place FROM s WHERE structure = 'numbered_list') SELECT answer_id, place::BIGINT AS place, item FROM i",
    "lexicon_sentiment": f"WITH {_ANS}, w AS (SELECT answer_id, text, list_distinct(regexp_extract_all(lower(text), '[а-яА-ЯёЁa-zA-Z]+')) AS ws FROM ans),\n"
    f"h AS (SELECT *, len(list_intersect(ws, [{_GOODS}])) AS g, len(list_intersect(ws, [{_BADS}])) AS b FROM w), s AS (SELECT *, coalesce(round((g - b)::DOUBLE / nullif(g + b, 0)::DOUBLE, 2), 0.0) AS score FROM h)\n"
    "SELECT answer_id, score, CASE WHEN score > 0.25 THEN 'positive' WHEN score < -0.25 THEN 'negative' WHEN abs(score) <= 0.1 THEN 'neutral' ELSE 'mixed' END AS label, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{t}' END" for t, p in T.TAGS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM s",
    "citations_extract": f"WITH {_ANS}" + r""", u AS (SELECT DISTINCT answer_id, unnest(list_transform(regexp_extract_all(text, 'https?://[^\s)\]"''>]+'), lambda x: regexp_replace(x, '[.,;:]+$', ''))) AS url FROM ans)
SELECT url, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '') AS domain, count(*) AS answers FROM u GROUP BY ALL""",
    "token_cost": "WITH " + "calls AS (SELECT 'v' || (user_id % 6)::VARCHAR AS vendor, floor(value)::BIGINT AS tokens, floor(value * 7)::BIGINT % 3000 AS latency_ms FROM events), p AS (SELECT *, CASE vendor WHEN 'v0' THEN 2.5::DOUBLE WHEN 'v1' THEN 0.15::DOUBLE WHEN 'v2' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS pin, CASE vendor WHEN 'v0' THEN 10.0::DOUBLE WHEN 'v1' THEN 0.6::DOUBLE WHEN 'v2' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS pout FROM calls) SELECT vendor, count(*) AS calls, round(sum(round((tokens * pin + latency_ms * pout) / 1e6, 6)), 4) AS cost FROM p GROUP BY 1",
}
_AT = f"CASE WHEN flag IN ('clean', 'think_stripped') AND {_HAS} THEN length({_PREFIX})::BIGINT ELSE -1 END"
_CTX = "CASE WHEN pos >= 0 THEN trim(substr(clean, (greatest(0, pos - 500) + 1)::BIGINT, (pos + 500 - greatest(0, pos - 500))::BIGINT)) END"
_MENTION = _PRE + rf""", m AS (SELECT *, {_AT} AS pos FROM s), c AS (SELECT *, {_CTX} AS ctx FROM m),
k AS (SELECT *, CASE WHEN ctx IS NULL THEN 'none' WHEN regexp_matches(lower(ctx), '{T.RECOMMENDED}') THEN 'recommended' WHEN regexp_matches(lower(ctx), '{T.COMPARED}') THEN 'compared' WHEN regexp_matches(lower(ctx), '{T.NEGATIVE}') THEN 'negative' ELSE 'direct' END AS mention_type,
 coalesce(list_position(list_transform(CASE structure WHEN 'numbered_list' THEN regexp_extract_all(clean, '(?m)^([0-9]+)\. (.+)$', 2) WHEN 'bulleted_list' THEN regexp_extract_all(clean, '(?m)^- (.+)$', 1)
   WHEN 'table' THEN list_filter(regexp_extract_all(clean, '(?m)^\|(.+)\|$', 1), lambda x: regexp_matches(x, '[^-|]')) ELSE [] END, lambda x: regexp_matches(lower(x), '(?:^|[^а-яёa-z0-9])brand#1(?:[^а-яёa-z0-9]|$)')), true), 0)::BIGINT AS rank FROM c)
"""
ORACLES["mention_offsets"] = _MENTION + r"""SELECT answer_id, pos AS "at", CASE WHEN pos >= 0 THEN len(regexp_extract_all(left(clean, pos), '[.!?]\s+'))::BIGINT END AS sentence, mention_type, rank FROM k"""
_SCORED = f"""{_MENTION}, w AS (SELECT *, list_distinct(regexp_extract_all(lower(ctx), '[а-яА-ЯёЁa-zA-Z]+')) AS ws FROM k WHERE pos >= 0),
h AS (SELECT *, len(list_intersect(ws, [{_GOODS}])) AS g, len(list_intersect(ws, [{_BADS}])) AS b FROM w), sc AS (SELECT *, coalesce(round((g - b)::DOUBLE / nullif(g + b, 0)::DOUBLE, 2), 0.0) AS score FROM h),
lb AS (SELECT *, CASE WHEN score > 0.25 THEN 'positive' WHEN score < -0.25 THEN 'negative' WHEN abs(score) <= 0.1 THEN 'neutral' ELSE 'mixed' END AS label,
 CASE WHEN structure = 'narrative' THEN CASE WHEN pos / length(clean)::DOUBLE < 0.2 THEN 1.0 WHEN pos / length(clean)::DOUBLE < 0.5 THEN 0.7 WHEN pos / length(clean)::DOUBLE < 0.8 THEN 0.4 ELSE 0.2 END
  WHEN rank <= 0 THEN 0.3 WHEN structure = 'bulleted_list' THEN 0.8 WHEN rank >= 10 THEN 0.1 ELSE round(1.0 - (rank - 1) * 0.1, 1) END::DOUBLE AS weight FROM sc)
"""
ORACLES["rvs_scores"] = _SCORED + "SELECT structure, mention_type, label, count(*) AS n, round(sum(round(weight * CASE label WHEN 'positive' THEN 1.2::DOUBLE WHEN 'negative' THEN 0.5::DOUBLE WHEN 'mixed' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 4)), 2) AS rvs FROM lb GROUP BY ALL"
