"""Queries that resolve brands in answers, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators.resolve import match_extracted, resolve
from sightline.sources.tables import table

_PROJECT = "1 + p_size % 4"
_ONE = "replace(p_name, ' ', '')"
#: The letters of part names in Cyrillic.
_CYR = "translate({}, 'abdegilmnoprtvwz', 'абдегилмнопртввз')"
_VARIANT = f"""CASE (l_linenumber + l_partkey) % 7 WHEN 0 THEN {_ONE} WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') || '!' WHEN 3 THEN {_CYR.format(_ONE)} WHEN 4 THEN {_ONE} || 's' WHEN 5 THEN 'x' || {_ONE} ELSE 'none' END
 || CASE l_linenumber % 4 WHEN 0 THEN ' is the best choice. ' WHEN 1 THEN ' is weak? ' WHEN 2 THEN ', unlike others; ' ELSE ' is sold here. ' END"""
_LINES = f"SELECT l_orderkey AS answer_id, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS d, p_name, {_VARIANT} AS body FROM lineitem JOIN part ON l_partkey = p_partkey"
_PROMPT = "CASE WHEN answer_id % 5 = 0 THEN 'Is ' || lead || ' any good?' WHEN answer_id % 5 = 1 THEN 'What is good?' END"


def brand_names(spark, sf_dir):
    """(project, brand, role, ord, n, name): part names as brands, spelled in three ways; the first of a project is its target."""
    p = table(spark, sf_dir, "part").selectExpr(f"{_PROJECT} AS project", "p_name").distinct()
    first = p.groupBy("project").agg(F.min("p_name").alias("lead"))
    p = p.join(first, "project").select("project", "p_name", F.when(F.col("p_name") == F.col("lead"), "target").otherwise("competitor").alias("role"))
    p = p.withColumn("ord", F.when(F.col("role") == "target", 0).otherwise(F.ascii(F.col("p_name"))))
    spelled = F.array(F.expr(_ONE), F.col("p_name"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("!")))
    return p.select("project", F.expr(_ONE).alias("brand"), "role", "ord", F.posexplode(spelled).alias("n", "name"))


def named_answers(spark, sf_dir):
    """(answer_id, project, text, prompt): an order's lines as one text."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x = l.join(p, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS answer_id", "l_linenumber AS a", "l_partkey AS b", "l_suppkey AS c", "l_extendedprice AS d", "p_name", f"{_VARIANT} AS body")
    g = x.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "c", "d", "body"))).alias("rows"), F.min("p_name").alias("lead"))
    return g.select("answer_id", (1 + F.col("answer_id") % 4).cast("int").alias("project"), F.array_join(F.transform("rows", lambda r: r["body"]), "").alias("text"), F.expr(_PROMPT).alias("prompt"))


def _resolved(spark, sf_dir, near_steps=True):
    d = resolve(named_answers(spark, sf_dir), brand_names(spark, sf_dir), near_steps)
    return d.select("answer_id", "brand", "role", "step", F.array_join("aliases", "|").alias("aliases"), "at", "sentence", "mention_type", F.length("context").cast("long").alias("context_chars"))


def resolved_mentions(spark, sf_dir):
    """Brands that answers name as they are written."""
    return _resolved(spark, sf_dir, near_steps=False).where("step = 'exact'").drop("step")


def fuzzy_mentions(spark, sf_dir):
    """Brands that answers name in the other script or by a longer word only."""
    return _resolved(spark, sf_dir).where("step <> 'exact'")


def extracted(spark, sf_dir):
    """(answer_id, position, name): the first word of each line of an answer."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.selectExpr("l_orderkey AS answer_id", "l_linenumber AS position", f"CASE l_linenumber % 3 WHEN 0 THEN {_CYR.format(_ONE)} WHEN 1 THEN initcap(p_name) ELSE 'Group ' || {_ONE} END AS name")


def _given(spark, sf_dir):
    return match_extracted(named_answers(spark, sf_dir), extracted(spark, sf_dir), brand_names(spark, sf_dir))


def extracted_mentions(spark, sf_dir):
    """Extracted entities by the brand that each went to."""
    return _given(spark, sf_dir)[0].select("answer_id", "brand", "role", "entity", "at", F.length("context").cast("long").alias("context_chars"))


def discovered_entities(spark, sf_dir):
    """Extracted entities that are no known brand, by project and name."""
    d = _given(spark, sf_dir)[1].join(named_answers(spark, sf_dir).select("answer_id", "project"), "answer_id")
    return d.groupBy("project", "name").agg(F.count("*").alias("mentions"), F.countDistinct("answer_id").alias("answers"))


QUERIES = {
    "resolved_mentions": resolved_mentions,
    "fuzzy_mentions": fuzzy_mentions,
    "extracted_mentions": extracted_mentions,
    "discovered_entities": discovered_entities,
}

_EDGE = "[а-яА-ЯёЁa-zA-Z0-9]"
_ANSWERS = f"""lines AS ({_LINES}), texts AS (SELECT answer_id, 1 + answer_id % 4 AS project, string_agg(body, '' ORDER BY a, b, c, d, body) AS text, min(p_name) AS lead FROM lines GROUP BY answer_id),
ans AS (SELECT answer_id, project, text, coalesce({_PROMPT}, '') AS prompt FROM texts),
p AS (SELECT DISTINCT {_PROJECT} AS project, p_name FROM part), r AS (SELECT *, CASE WHEN p_name = min(p_name) OVER (PARTITION BY project) THEN 'target' ELSE 'competitor' END AS role FROM p),
names AS (SELECT project, {_ONE} AS brand, role, unnest([0, 1, 2]) AS n, unnest([{_ONE}, p_name, replace(p_name, ' ', '-') || '!']) AS name FROM r)"""
_PLACES = f"""list_filter(range(length(text)::BIGINT), lambda i: substr(lower(text), i + 1, length(name)) = name AND NOT regexp_matches(substr(text, i, CASE WHEN i = 0 THEN 0 ELSE 1 END), '{_EDGE}') AND NOT regexp_matches(substr(text, i + length(name) + 1, 1), '{_EDGE}'))"""
_PHRASE = "CASE WHEN contains(context, 'best choice') THEN 'recommended' WHEN contains(context, 'unlike') THEN 'compared' WHEN contains(context, 'weak') THEN 'negative' ELSE 'direct' END"

ORACLES = {
    "resolved_mentions": f"""WITH {_ANSWERS}, near AS (SELECT * FROM ans JOIN names USING (project) WHERE contains(lower(text), name)), hit AS (SELECT *, list_min({_PLACES}) AS pos FROM near),
echo AS (SELECT DISTINCT answer_id, brand FROM ans JOIN names USING (project) WHERE contains(lower(prompt), name)),
m AS (SELECT answer_id, brand, any_value(role) AS role, string_agg(name, '|' ORDER BY n) AS aliases, min(pos) AS pos, any_value(text) AS text FROM hit WHERE pos IS NOT NULL GROUP BY ALL),
c AS (SELECT *, trim(substr(text, greatest(0, pos - 500) + 1, pos + 500 - greatest(0, pos - 500))) AS context FROM m ANTI JOIN echo USING (answer_id, brand))
SELECT answer_id, brand, role, aliases, pos AS "at", len(regexp_extract_all(left(text, pos::BIGINT), '[.!?]\\s+'))::BIGINT AS sentence, {_PHRASE} AS mention_type, length(context)::BIGINT AS context_chars FROM c""",
}
