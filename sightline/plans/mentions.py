"""Queries over entity mentions, judged answers and traced prompts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import mentions as M
from sightline.plans.answers import _ANS, _MENTION, _SCORED, BRAND, analyzed, answers
from sightline.plans.entities import ORACLES as _ENTITIES
from sightline.sources.tables import table

# expressions that both engines read
_NAME = "CASE l_suppkey % 3 WHEN 0 THEN ' ' || p_brand || '.' WHEN 1 THEN upper(p_brand) ELSE replace(p_brand, '#', '—') END"
_CONTEXT = "CASE WHEN l_quantity < 10 THEN '' ELSE 'ctx ' || CAST(CAST(l_quantity AS BIGINT) % 12 AS STRING) END"
_ELEMENT = "CASE WHEN a % 5 = 4 THEN '{\"title\":\"x\"}' WHEN a % 3 = 0 THEN '\"' || name || '\"' ELSE '{\"name\":\"' || name || '\",\"context\":\"' || ctx || '\",\"type\":\"org\"}' END"
_PROMPT = "CASE answer_id % 4 WHEN 0 THEN 'Is BRAND#1 any good?' WHEN 1 THEN 'Is there more than Brand#2?' WHEN 2 THEN NULL ELSE 'Which widget is best?' END"
_STATUS = "CASE answer_id % 5 WHEN 3 THEN 'censored' WHEN 4 THEN 'failed' ELSE 'success' END"
_VERDICT = """CASE o_orderkey % 4 WHEN 0 THEN 'Sure: {"same_entity": true, "confidence": 0.9} ok' WHEN 1 THEN '{"same_entity": true, "confidence": 0.7}' WHEN 2 THEN 'no' ELSE '{"same_entity": false, "confidence": 1.0}' END"""
_ASKED = "CASE WHEN prompt_id < '8' THEN prompt WHEN prompt_id < 'e' THEN 'So: ' || prompt ELSE 'Hello there' END"
JUDGES = (
    '{"mention_type":" Recommended ","sentiment_score":2.5,"sentiment_label":"positive"}', '```json\n{"sentiment_score":-0.5,"sentiment_label":"odd","is_hallucination":true}\n```', "no json",
    '{"mention_type":"garbage","is_recommended":true}', None, '{"sentiment_score":"x"}', '{"mention_type":"negative","sentiment_score":0.05,"sentiment_label":"odd"}',
)


def _parsed(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    x = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    x = x.selectExpr("l_orderkey AS answer_id", "l_linenumber AS a", "l_partkey AS b", "l_suppkey AS c", "l_extendedprice AS d", f"{_NAME} AS name", f"{_CONTEXT} AS ctx").withColumn("e", F.expr(_ELEMENT))
    g = x.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "c", "d", "e"))).alias("rows"))  # an order's lines
    return M.parsed(g.select("answer_id", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["e"]), ","), F.lit("]")).alias("raw")))


def entity_mentions(spark, sf_dir):
    return _parsed(spark, sf_dir)


def mention_groups(spark, sf_dir):
    return M.by_entity(_parsed(spark, sf_dir)).withColumn("contexts", F.array_join("contexts", "|"))


def fallback_mentions(spark, sf_dir):
    d = M.fallback(answers(spark, sf_dir).withColumn("prompt", F.expr(_PROMPT)), F.lit(BRAND), ["Brand#2", "Brand#3"])
    return d.select("answer_id", "brand_mentioned", "mention_type", F.length("mention_context").cast("long").alias("context_chars"), F.array_join("named", ",").alias("named"))


def judged_answers(spark, sf_dir):
    said = F.array(*[F.lit(j) for j in JUDGES])[(F.col("answer_id") % 7).cast("int")]
    d = M.judged(analyzed(spark, sf_dir).where("at >= 0").select("answer_id", "mention_type", "label", "score").withColumn("judge", said))
    return d.drop("judge")


def normal_responses(spark, sf_dir):
    d = answers(spark, sf_dir).selectExpr("answer_id", "text", f"{_STATUS} AS status", "answer_id % 100 AS input_tokens", "answer_id % 7 AS output_tokens", "CASE WHEN answer_id % 2 = 0 THEN 0 ELSE 999 END AS total_tokens",
                                          "CASE answer_id % 3 WHEN 0 THEN array(' https://a.example/x. ', 'https://a.example/x', '') WHEN 1 THEN array() END AS cited_urls")
    d = M.normal_responses(d)
    return d.select("answer_id", "status", F.col("total_tokens").cast("long").alias("total_tokens"), F.array_join(F.array_sort("cited_urls"), " ").alias("urls"), F.length("text").cast("long").alias("n_chars"))


def score_texts(spark, sf_dir):
    return M.score_texts(analyzed(spark, sf_dir)).select("answer_id", "position_source", "sentiment_source", "rvs_formula")


def prompt_trace(spark, sf_dir):
    from sightline.operators.prompts import TEMPLATES
    from sightline.plans.entities import _prompts

    d = _prompts(spark, sf_dir).select("prompt_id", F.expr(_ASKED).alias("prompt"))
    return M.traced(d, list(TEMPLATES)).select("prompt_id", "intent", "match")


def confirmed_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS a", "o_custkey AS b", f"{_VERDICT} AS verdict")
    return M.confirmed(o).select("a", "b")


def borderline_pairs(spark, sf_dir):
    """Pairs of overlapping groups of vectors whose means lie between the bounds: eight groups of each label, each without a quarter of its vectors."""
    v = table(spark, sf_dir, "embeddings").where("label is not null").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    v = v.where(F.pmod(F.expr("vec_id div 10") - F.col("k"), F.lit(8)) < 6).select((F.col("label") * 8 + F.col("k")).alias("c"), "embedding")
    d = M.borderline(v, "c", "embedding")
    return d.select("a", "b", F.round("distance", 5).alias("distance"))


QUERIES = {f.__name__: f for f in (entity_mentions, mention_groups, fallback_mentions, judged_answers, normal_responses, score_texts, prompt_trace, confirmed_pairs, borderline_pairs)}

_ROWS = f"""r AS (SELECT l_orderkey AS answer_id, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, l_extendedprice AS d, {_NAME} AS name, {_CONTEXT} AS ctx FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT answer_id, (row_number() OVER (PARTITION BY answer_id ORDER BY a, b, c, d, name, ctx) - 1)::INT AS position, name, CASE WHEN a % 3 = 0 THEN '' ELSE ctx END AS context, CASE WHEN a % 3 = 0 THEN 'other' ELSE 'org' END AS type, a FROM r),
e AS (SELECT answer_id, position, name, context, type FROM m WHERE a % 5 <> 4)"""
_NEAR = "substr(text, (greatest(pos - {0}, 0) + 1)::BIGINT, (pos + 7 + {0} - greatest(pos - {0}, 0))::BIGINT)"
_FACTOR = "CASE label WHEN 'positive' THEN '1.2' WHEN 'negative' THEN '0.5' WHEN 'mixed' THEN '0.8' ELSE '1.0' END"

ORACLES = {
    "entity_mentions": f"WITH {_ROWS} SELECT * FROM e",
    "mention_groups": f"""WITH {_ROWS}, k AS (SELECT *, replace(replace(replace(trim(lower(name)), '.', ''), ',', ''), '—', '-') AS key FROM e),
c AS (SELECT key, string_agg(context, '|' ORDER BY context) AS contexts FROM (SELECT DISTINCT key, context FROM k WHERE context <> '' QUALIFY dense_rank() OVER (PARTITION BY key ORDER BY context) <= 5) GROUP BY 1)
SELECT key, arg_min(name, (answer_id, position)) AS name, arg_min(type, (answer_id, position)) AS type, count(*) AS mentions, count(DISTINCT answer_id) AS answers, coalesce(any_value(contexts), '') AS contexts FROM k LEFT JOIN c USING (key) GROUP BY key""",
    "fallback_mentions": f"""WITH {_ANS}, p AS (SELECT *, {_PROMPT} AS prompt FROM ans),
f AS (SELECT *, CASE WHEN NOT coalesce(contains(lower(prompt), 'brand#1'), false) AND regexp_matches(text, '(?i)\\bbrand#1\\b') THEN length(regexp_extract(text, '(?is)^(.*?)\\bbrand#1\\b', 1)) ELSE -1 END AS pos FROM p),
n AS (SELECT *, CASE WHEN pos >= 0 THEN {_NEAR.format(150)} END AS near, CASE WHEN pos >= 0 THEN length(trim({_NEAR.format(75)}, ' ')) END AS context_chars FROM f)
SELECT answer_id, pos >= 0 AS brand_mentioned, CASE WHEN near IS NULL THEN 'none' WHEN regexp_matches(near, '(?i){M.CRITICAL}') THEN 'negative' WHEN regexp_matches(near, '(?i)\\bbrand#[23]\\b') AND regexp_matches(near, '(?i){M.COMPARING}') THEN 'compared'
 WHEN regexp_matches(near, '(?i){M.RECOMMENDING}') THEN 'recommended' ELSE 'direct' END AS mention_type, context_chars,
 concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\\bbrand#2\\b') AND NOT coalesce(contains(lower(prompt), 'brand#2'), false) THEN 'Brand#2' END, CASE WHEN regexp_matches(text, '(?i)\\bbrand#3\\b') THEN 'Brand#3' END) AS named FROM n""",
    "judged_answers": _SCORED + """, j AS (SELECT *, answer_id % 7 AS i FROM lb) SELECT answer_id, CASE i WHEN 0 THEN 'recommended' WHEN 3 THEN 'recommended' WHEN 6 THEN 'negative' ELSE mention_type END AS mention_type,
 CASE i WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 3 THEN 'neutral' WHEN 6 THEN 'neutral' ELSE label END AS label, CASE i WHEN 0 THEN 1.0 WHEN 1 THEN -0.5 WHEN 3 THEN 0.0 WHEN 6 THEN 0.05 ELSE score END::DOUBLE AS score,
 i IN (0, 1, 3, 6) AS by_judge, i = 3 AS is_recommended, i = 1 AS is_hallucination FROM j""",
    "normal_responses": f"""WITH {_ANS}, s AS (SELECT *, {_STATUS} AS status, regexp_extract_all(text, 'https?://[^\\s)\\]}}"''<>,]+') AS found FROM ans)
SELECT answer_id, status, (CASE WHEN answer_id % 2 = 0 THEN answer_id % 100 + answer_id % 7 ELSE 999 END)::BIGINT AS total_tokens,
 CASE WHEN answer_id % 3 = 0 THEN 'https://a.example/x' WHEN status = 'success' THEN coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda u: regexp_replace(u, '[.,;:!?)]+$', '')))), ' '), '') ELSE '' END AS urls,
 CASE WHEN status = 'censored' THEN 20 ELSE length(text) END::BIGINT AS n_chars FROM s""",
    "score_texts": _SCORED + f"""SELECT answer_id, CASE WHEN structure = 'narrative' THEN 'narrative: char_offset=' || pos || ' → proximity weight ' || weight::VARCHAR WHEN rank <= 0 THEN structure || ': brand not found in list items → default 0.3'
 WHEN structure = 'bulleted_list' THEN 'bulleted_list: uniform weight → ' || weight::VARCHAR ELSE structure || ': rank #' || rank || ' → 1.0 - (' || rank || '-1)×0.1 = ' || weight::VARCHAR END AS position_source, label || ' → ' || {_FACTOR} AS sentiment_source,
 'RVS = 1.0 × ' || weight::VARCHAR || ' × ' || {_FACTOR} || ' = ' || round(weight * ({_FACTOR})::DOUBLE, 4)::VARCHAR AS rvs_formula FROM lb
UNION ALL SELECT answer_id, 'not mentioned → 0.0', 'neutral → 1.0', 'RVS = 0.0 (brand not mentioned)' FROM k WHERE pos < 0""",
    "prompt_trace": "WITH p AS (" + _ENTITIES["prompt_matrix"] + ") SELECT prompt_id, CASE WHEN prompt_id < 'e' THEN intent END AS intent, CASE WHEN prompt_id < '8' THEN 'exact' WHEN prompt_id < 'e' THEN 'fuzzy' ELSE 'none' END AS match FROM p",
    "confirmed_pairs": "SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 4 = 0",
    "borderline_pairs": f"""WITH g AS (SELECT label * 8 + k AS label, embedding FROM embeddings, range(8) AS t(k) WHERE label IS NOT NULL AND ((vec_id // 10 - k) % 8 + 8) % 8 < 6), x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM g), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
v AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1), d AS (SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS d FROM v a JOIN v b ON a.label < b.label)
SELECT a, b, round(d, 5) AS distance FROM d WHERE d BETWEEN 0.12 AND 0.18 ORDER BY d, a, b LIMIT 20""",
}
