"""Reference-shaped facts derived from the given tables.

Every column is an expression that both Spark and DuckDB read, so a query and its SQL start from the same rows; integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.tables import table

COMPETITORS = ("Acme", "Globex", "Initech", "Acme::Lite", "Globex::Pro")

SNAP = {
    "query_id": "l_partkey",
    "answer_id": "l_orderkey * 10 + l_linenumber",
    "day": "CAST(l_shipdate AS DATE)",
    "provider": "l_returnflag || '-' || l_linestatus",
    "mention_type": "CASE l_linenumber WHEN 1 THEN 'direct' WHEN 2 THEN 'recommended' WHEN 3 THEN 'compared' WHEN 4 THEN 'negative' ELSE 'none' END",
    "brand_mentioned": "l_linenumber <= 4",
    "sentiment_label": "CASE CAST(l_quantity AS BIGINT) % 6 WHEN 0 THEN 'positive' WHEN 1 THEN 'Negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'mixed' WHEN 4 THEN '' ELSE NULL END",
    "position_rank": "CASE WHEN CAST(round(l_tax * 100) AS BIGINT) = 8 THEN NULL ELSE CAST(round(l_tax * 100) AS BIGINT) END",
    "structure_type": "CASE CAST(round(l_discount * 100) AS BIGINT) % 5 WHEN 0 THEN 'numbered_list' WHEN 1 THEN 'bulleted_list' WHEN 2 THEN 'table' WHEN 3 THEN 'mixed' ELSE 'narrative' END",
    "is_hallucination": "CASE WHEN CAST(l_quantity AS BIGINT) % 4 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 4 = 1 END",
    "tokens": "CAST(l_quantity AS BIGINT) * 10 - 10",
    "cost_usd": "CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN 0.0 ELSE CAST(round(l_extendedprice) AS DOUBLE) / 1000000 END",
    "no_map": "l_quantity < 5",
    "c1": "l_suppkey % 3 = 0",
    "c2": "l_partkey % 4 = 0",
    "c3": "l_suppkey % 5 = 0",
    "c4": "l_partkey % 7 = 0",
    "c5": "(l_suppkey + l_partkey) % 11 = 0",
    "u1": "CASE WHEN l_linenumber % 2 = 0 THEN 'https://www.site' || CAST(l_suppkey % 20 AS STRING) || '.example.com/p/' || CAST(l_partkey % 50 AS STRING) END",
    "u2": "CASE WHEN l_linenumber % 3 = 0 THEN 'http://Site' || CAST(l_suppkey % 7 AS STRING) || '.example.org:8080/x?y=1' END",
    "u3": "CASE WHEN l_linenumber % 4 = 0 THEN 'https://www.site' || CAST(l_suppkey % 20 AS STRING) || '.example.com/p/' || CAST(l_partkey % 50 AS STRING) END",
}
QUERY = {
    "query_id": "p_partkey",
    "project_id": "1 + p_size % 4",
    "query_type": "CASE p_partkey % 5 WHEN 0 THEN 'comparison' WHEN 1 THEN 'recommendation' WHEN 2 THEN 'brand_check' WHEN 3 THEN 'custom' ELSE 'other' END",
    "category": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_type END",
    "query_class": "CASE p_partkey % 6 WHEN 0 THEN 'thematic' WHEN 1 THEN 'branded' WHEN 2 THEN 'seasonal' WHEN 3 THEN 'thematic' WHEN 4 THEN 'branded' ELSE NULL END",
    "subtype": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'price' WHEN 2 THEN 'review' ELSE 'howto' END",
    "active": "p_partkey % 10 <> 0",
    "query_text": "p_name || ' vs ' || p_brand",
    "target_brand": "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'BRAND#11' END",
}
KEYWORD = {
    "keyword_id": "c_custkey",
    "project_id": "c_nationkey",
    "keyword": "lower(c_name)",
    "target_url": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'https://site.example/p' || CAST(c_custkey % 40 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END END",
    "active": "c_acctbal > 0",
    "tenant": "'t' || CAST(c_nationkey % 5 AS STRING)",
}
RANK = {
    "keyword_id": "user_id",
    "day": "CAST(ts AS DATE)",
    "engine": "CASE event_id % 2 WHEN 0 THEN 'google' ELSE 'yandex' END",
    "position": "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) % 100 END",
    "found_url": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'https://site.example/p' || CAST(event_id % 40 AS STRING) END",
    "inserted_at": "ts",
    "version": "event_id",
}
WEB = {
    "keyword_id": "user_id",
    "day": "CAST(ts AS DATE)",
    "impressions": "CAST(floor(value * 10) AS BIGINT) % 500",
    "clicks": "(CAST(floor(value * 10) AS BIGINT) % 500) // 10",
    "position": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 50 AS DOUBLE) END",
    "page_url": "'https://site.example/p' || CAST(event_id % 40 AS STRING)",
    "query_text": "CASE WHEN event_id % 3 = 0 THEN 'customer#' || CAST(user_id AS STRING) ELSE 'query ' || CAST(event_id % 500 AS STRING) END",
    "ord": "event_id",
}
CALL = {
    "call_id": "event_id",
    "ts": "ts",
    "vendor": "'v' || CAST(user_id % 6 AS STRING)",
    "ok": "event_type <> 'error'",
    "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'censored' ELSE 'success' END",
    "prompt_id": "user_id",
    "tokens": "CAST(floor(value) AS BIGINT)",
    "latency_ms": "CAST(floor(value * 7) AS BIGINT) % 3000",
    "cost_micros": "CAST(floor(value * 10) AS BIGINT)",
}
ENTITY = {
    "entity_id": "s_suppkey",
    "project_id": "1 + s_nationkey % 4",
    "name": "s_name",
    "status": "CASE s_suppkey % 6 WHEN 0 THEN 'rejected' WHEN 1 THEN 'promoted' WHEN 2 THEN 'confirmed' ELSE 'pending' END",
    "alias_of": "CASE WHEN s_suppkey % 7 = 4 THEN s_suppkey - 1 END",
    "mentions": "CAST(floor(abs(s_acctbal)) AS BIGINT) % 50",
    "last_seen": "DATE '2024-01-01' + CAST(s_suppkey % 30 AS INT)",
    "suggested_parent": "CASE WHEN s_suppkey % 5 = 0 THEN 'Acme' END",
}

_SOURCE = {"snap": (SNAP, "lineitem"), "q": (QUERY, "part"), "kw": (KEYWORD, "customer"), "ranks": (RANK, "events"), "web": (WEB, "events"), "calls": (CALL, "events"), "ents": (ENTITY, "supplier")}


def _spark_form(expr: str) -> str:
    return expr.replace(" // ", " DIV ")


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, source = _SOURCE[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{_spark_form(e)} AS {c}" for c, e in columns.items()])


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer facts with competitor_mentions (map, null where the reference has none) and cited_urls (array)."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, COMPETITORS)), F.array("c1", "c2", "c3", "c4", "c5"))
    s = facts(spark, sf_dir, "snap").withColumn("competitor_mentions", F.when(~F.col("no_map"), pairs))
    return s.withColumn("cited_urls", F.array_compact(F.array("u1", "u2", "u3"))).drop("no_map", "c1", "c2", "c3", "c4", "c5", "u1", "u2", "u3")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer facts with the columns of their queries."""
    return snapshots(spark, sf_dir).join(facts(spark, sf_dir, "q"), "query_id")


def cte(*names: str) -> str:
    """WITH clause of the same views for DuckDB; sq is snap joined to q, mentions and cites are exploded forms of snap."""
    out = [f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _SOURCE[n][0].items())} FROM {_SOURCE[n][1]})" for n in _SOURCE if n in names or ({"sq", "mentions", "cites"} & set(names) and n in ("snap", "q"))]
    if {"sq", "mentions", "cites"} & set(names):
        out.append("sq AS (SELECT * FROM snap JOIN q USING (query_id))")
    if "mentions" in names:
        each = ", ".join(f"CASE WHEN c{i} THEN '{c}' END" for i, c in enumerate(COMPETITORS, 1))
        out.append(f"mentions AS (SELECT * FROM (SELECT sq.*, unnest([{each}]) AS competitor FROM sq WHERE NOT no_map) WHERE competitor IS NOT NULL)")
    if "cites" in names:
        out.append("cites AS (SELECT * FROM (SELECT sq.*, unnest([u1, u2, u3]) AS url FROM sq) WHERE url IS NOT NULL)")
    return "WITH " + ",\n".join(out) + "\n"
