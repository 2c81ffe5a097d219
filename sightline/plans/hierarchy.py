"""Queries over aliases, sub-brands and scenarios, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import hierarchy as H
from sightline.operators import visibility as V
from sightline.sources.adapters import COMPETITORS, cte, joined
from sightline.sources.tables import table

# expressions that both engines read: chains, circles of two with chains that lead into them, aliases of one brand, and names of their own
_ALIAS = """CASE WHEN s_suppkey % 12 = 4 AND s_suppkey >= 40 THEN s_suppkey - 4 WHEN s_suppkey % 12 = 8 AND s_suppkey >= 40 THEN s_suppkey - 4 WHEN s_suppkey % 36 = 1 THEN s_suppkey + 12 WHEN s_suppkey % 36 = 13 THEN s_suppkey - 12
 WHEN s_suppkey % 36 = 25 THEN s_suppkey - 12 WHEN s_suppkey % 3 = 2 AND s_suppkey >= 40 THEN s_suppkey % 20 WHEN s_suppkey % 36 = 30 THEN -5 END"""
_NAME = "CASE WHEN s_suppkey >= 20 THEN s_name WHEN s_suppkey >= 16 THEN 'Own' WHEN s_suppkey >= 12 THEN 'Pro' WHEN s_suppkey >= 8 THEN 'Lite' WHEN s_suppkey >= 4 THEN 'Globex' ELSE 'Acme' END"
ENTITIES = {
    "project_id": "1 + s_suppkey % 4", "id": "s_suppkey", "name": _NAME, "alias_of": _ALIAS, "status": f"CASE WHEN {_ALIAS} IS NOT NULL THEN 'alias' WHEN s_suppkey % 6 = 0 THEN 'rejected' ELSE 'pending' END",
    "mentions": "CAST(floor(abs(s_acctbal)) AS BIGINT) % 50", "suggested_parent": "CASE WHEN s_suppkey % 5 = 0 THEN 'Acme' END",
}
_PARENT = "CASE WHEN s_suppkey % 2 = 0 THEN 'Own' ELSE 'Acme' END"
SUBS = {"project_id": "1 + s_suppkey % 4", "parent": _PARENT, "name": "s_name"}
_IS_SUB = "s_suppkey % 9 = 3 AND s_suppkey >= 20"
_MOVE = "CASE s_suppkey % 4 WHEN 0 THEN 'Globex' WHEN 1 THEN 'Nobody' WHEN 2 THEN 'Acme' ELSE 'Own' END"
#: Brands that are tracked, with the keys of their answers; sub-brands of the competitor map.
TRACKED = (("Own", "__brand__"), ("Acme", "Acme"), ("Globex", "Globex"), ("Initech", "Initech"))


def _view(spark, sf_dir, columns: dict[str, str], where: str = "true"):
    return table(spark, sf_dir, "supplier").where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def entities(spark, sf_dir):
    return _view(spark, sf_dir, ENTITIES)


def subs(spark, sf_dir):
    return _view(spark, sf_dir, SUBS, _IS_SUB).withColumn("aliases", F.array(F.lower("name")))


def parents(spark, sf_dir):
    return spark.range(1, 5).select(F.col("id").alias("project_id"), F.explode(F.array(*map(F.lit, ("Own", "Acme", "Globex")))).alias("name"))


def alias_roots(spark, sf_dir):
    return H.chain_ends(entities(spark, sf_dir)).select(F.col("node").alias("id"), "root", "cyclic")


def alias_totals(spark, sf_dir):
    return H.totals_by_root(entities(spark, sf_dir))


def mention_totals(spark, sf_dir):
    """Answers of each brand by project, with its aliases' mentions, and with its sub-brands'."""
    d = joined(spark, sf_dir).select("project_id", "brand_mentioned", "competitor_mentions")
    found = V.competitor_mentions(d, rolled_up=False).select("project_id", F.col("competitor").alias("key"))
    counts = found.unionByName(d.where("brand_mentioned").select("project_id", F.lit("__brand__").alias("key"))).groupBy("project_id", "key").agg(F.count("*").alias("n"))
    tracked = spark.range(1, 5).select(F.col("id").alias("project_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("key")) for n, k in TRACKED))).alias("t")).select("project_id", "t.*")
    below = [c.split("::") for c in COMPETITORS if "::" in c]
    s = spark.range(1, 5).select(F.col("id").alias("project_id"), F.explode(F.array(*(F.struct(F.lit(p).alias("parent"), F.lit(n).alias("name")) for p, n in below))).alias("t")).select("project_id", "t.*")
    return H.mention_totals(counts, tracked, s, entities(spark, sf_dir))


def seen_alias_reset(spark, sf_dir):
    seen = _view(spark, sf_dir, {k: ENTITIES[k] for k in ("project_id", "name")}, "s_suppkey % 4 < 2")
    return H.reset_seen(entities(spark, sf_dir), seen).select("id", "alias_of", "status")


def enriched_sub_brands(spark, sf_dir):
    d = H.enriched(subs(spark, sf_dir), entities(spark, sf_dir))
    return d.select("project_id", "parent", "name", F.array_join("aliases", ",").alias("aliases"))


def sub_brand_moves(spark, sf_dir):
    moves = _view(spark, sf_dir, {"project_id": SUBS["project_id"], "name": "s_name", "from_parent": "CASE WHEN s_suppkey % 7 = 0 THEN 'Globex' ELSE " + _PARENT + " END", "to_parent": _MOVE}, _IS_SUB)
    out, refused = H.move_subs(subs(spark, sf_dir), moves, parents(spark, sf_dir))
    return out.select("project_id", "name", F.col("parent").alias("state"), F.size("aliases").alias("n_aliases")).unionByName(refused.select("project_id", "name", F.concat(F.lit("refused: "), "reason").alias("state"), F.lit(0).alias("n_aliases")))


def sub_brand_reset(spark, sf_dir):
    return H.reset_subs(entities(spark, sf_dir), subs(spark, sf_dir)).select("id", "alias_of", "status", F.col("suggested_parent").isNull().alias("cleared"))


def _scenarios(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("1 + p_size % 4 AS project_id", "p_type", "p_brand")
    top = p.select("project_id", F.col("p_type").alias("name"), F.lit(None).cast("string").alias("parent"))
    return top.unionByName(p.groupBy("project_id", F.col("p_brand").alias("name")).agg(F.min("p_type").alias("parent"))).distinct()


def _renames(spark, sf_dir):
    s = _scenarios(spark, sf_dir)
    n = F.length("name")
    to = F.when(F.col("parent").isNull(), F.concat(F.lit("new "), "name")).when(n == 8, "Brand#11").when(F.col("name").endswith("1"), "One").otherwise(F.concat("name", F.lit("!")))
    return s.select("project_id", "name", to.alias("new_name")).unionByName(s.select("project_id").distinct().selectExpr("project_id", "'none' AS name", "'some' AS new_name"))


def scenario_renames(spark, sf_dir):
    """Scenarios after renames with their children and the number of prompts that follow them, and renames that are refused."""
    rows = table(spark, sf_dir, "part").selectExpr("1 + p_size % 4 AS project_id", "p_brand AS category")
    s, r, refused = H.rename_scenarios(_scenarios(spark, sf_dir), rows, _renames(spark, sf_dir))
    n = r.groupBy("project_id", F.col("category").alias("name")).agg(F.count("*").alias("prompts"))
    done = s.join(n, ["project_id", "name"], "left").select("project_id", "name", F.coalesce("parent", F.lit("")).alias("detail"), F.coalesce("prompts", F.lit(0)).alias("prompts"))
    return done.unionByName(refused.select("project_id", "name", F.concat(F.lit("refused: "), "reason").alias("detail"), F.lit(0).cast("long").alias("prompts")))


def suggestion_checks(spark, sf_dir):
    s = _view(spark, sf_dir, {
        "project_id": "1 + s_suppkey % 4", "entity": "CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN '\"' || s_name || '\" ' WHEN 2 THEN s_name || '?' ELSE '''' || s_name END", "parent": "CASE WHEN s_suppkey % 5 = 0 THEN 'Nobody' ELSE 'Acme' END",
        "confidence": "CASE WHEN s_suppkey % 3 = 0 THEN 'high' END",
    })
    return H.valid_suggestions(s, entities(spark, sf_dir), parents(spark, sf_dir))


def consolidation_counters(spark, sf_dir):
    key = F.expr("CASE root % 5 WHEN 0 THEN '__brand__' WHEN 1 THEN '__brand__::Lite' WHEN 2 THEN 'Acme' WHEN 3 THEN 'Globex::Pro' END")
    return H.consolidation_summary(alias_roots(spark, sf_dir).select(F.col("root").alias("cluster"), F.col("id").cast("string").alias("name"), key.alias("key")))


QUERIES = {
    "alias_roots": alias_roots,
    "alias_totals": alias_totals,
    "mention_totals": mention_totals,
    "seen_alias_reset": seen_alias_reset,
    "enriched_sub_brands": enriched_sub_brands,
    "sub_brand_moves": sub_brand_moves,
    "sub_brand_reset": sub_brand_reset,
    "scenario_renames": scenario_renames,
    "suggestion_checks": suggestion_checks,
    "consolidation_counters": consolidation_counters,
}

_ENTS = f"ents AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ENTITIES.items())} FROM supplier)"
_SUBS = f"subs AS (SELECT {', '.join(f'{e} AS {c}' for c, e in SUBS.items())}, lower(s_name) AS own FROM supplier WHERE {_IS_SUB})"
_ROOTS = f"""{_ENTS}, walk AS (SELECT id, id AS pos, [id] AS path, false AS stop, NULL::BIGINT AS root FROM ents
 UNION ALL SELECT w.id, n.id, w.path || [n.id], n.id IS NULL OR list_contains(w.path, n.id), CASE WHEN n.id IS NULL THEN w.pos WHEN list_contains(w.path, n.id) THEN list_min(w.path[list_position(w.path, n.id):]) END
  FROM walk w JOIN ents e ON e.id = w.pos LEFT JOIN ents n ON n.id = e.alias_of WHERE NOT w.stop),
roots AS (SELECT id, root, pos IS NOT NULL AS cyclic FROM walk WHERE stop)"""
_TREE = """s AS (SELECT DISTINCT 1 + p_size % 4 AS project_id, p_type AS name, NULL::VARCHAR AS parent FROM part UNION ALL SELECT 1 + p_size % 4, p_brand, min(p_type) FROM part GROUP BY ALL),
r AS (SELECT project_id, name, CASE WHEN parent IS NULL THEN 'new ' || name WHEN length(name) = 8 THEN 'Brand#11' WHEN name LIKE '%1' THEN 'One' ELSE name || '!' END AS new_name FROM s UNION ALL SELECT DISTINCT project_id, 'none', 'some' FROM s),
q AS (SELECT r.*, CASE WHEN NOT EXISTS (FROM s WHERE s.project_id = r.project_id AND s.name = r.name) THEN 'no such scenario' WHEN EXISTS (FROM s WHERE s.project_id = r.project_id AND s.name = r.new_name) THEN 'name taken'
 WHEN count(*) OVER (PARTITION BY project_id, new_name) > 1 THEN 'wanted twice' END AS reason FROM r WHERE name <> new_name)"""
_KEYS = ", ".join(f"('{n}', '{k}')" for n, k in TRACKED)
_BELOW = ", ".join(f"('{p}', '{n}')" for p, n in (c.split("::") for c in COMPETITORS if "::" in c))

ORACLES = {
    "alias_roots": f"WITH RECURSIVE {_ROOTS} SELECT id, root, cyclic FROM roots",
    "alias_totals": f"WITH RECURSIVE {_ROOTS} SELECT root, sum(CASE WHEN id = root THEN mentions ELSE 0 END)::BIGINT AS own, sum(mentions)::BIGINT AS total, count(*) AS members FROM ents JOIN roots USING (id) GROUP BY root",
    "mention_totals": cte("mentions") + f""", {_ENTS}, projects AS (SELECT unnest(range(1, 5)) AS project_id), counts AS (SELECT project_id, competitor AS key, count(*) AS n FROM mentions GROUP BY ALL UNION ALL SELECT project_id, '__brand__', count(*) FROM sq WHERE brand_mentioned GROUP BY ALL),
more AS (SELECT e.project_id, e.name, sum(a.mentions) AS more FROM ents e JOIN ents a ON a.alias_of = e.id AND a.project_id = e.project_id GROUP BY ALL), tracked AS (SELECT * FROM projects, (VALUES {_KEYS}) AS v(name, key)), below AS (SELECT * FROM projects, (VALUES {_BELOW}) AS v(parent, name)),
under AS (SELECT b.project_id, b.parent, sum(coalesce(c.n, 0) + coalesce(m.more, 0)) AS n FROM below b LEFT JOIN counts c ON c.project_id = b.project_id AND c.key = b.parent || '::' || b.name LEFT JOIN more m ON m.project_id = b.project_id AND m.name = b.name GROUP BY ALL)
SELECT t.project_id, t.name, coalesce(c.n, 0)::BIGINT AS own, (coalesce(c.n, 0) + coalesce(m.more, 0))::BIGINT AS with_aliases, (coalesce(c.n, 0) + coalesce(m.more, 0) + coalesce(u.n, 0))::BIGINT AS total
FROM tracked t LEFT JOIN counts c USING (project_id, key) LEFT JOIN more m USING (project_id, name) LEFT JOIN under u ON u.project_id = t.project_id AND u.parent = t.name""",
    "seen_alias_reset": f"WITH {_ENTS} SELECT id, CASE WHEN id % 4 < 2 THEN NULL ELSE alias_of END AS alias_of, CASE WHEN id % 4 < 2 AND alias_of IS NOT NULL THEN 'pending' ELSE status END AS status FROM ents",
    "enriched_sub_brands": f"""WITH {_ENTS}, {_SUBS}, a AS (SELECT e.project_id, e.name, list(a.name) AS more FROM ents e JOIN ents a ON a.alias_of = e.id AND a.project_id = e.project_id GROUP BY ALL)
SELECT s.project_id, s.parent, s.name, array_to_string(list_sort(list_distinct([own] || coalesce(more, []))), ',') AS aliases FROM subs s LEFT JOIN a USING (project_id, name)""",
    "sub_brand_moves": f"""WITH m AS (SELECT 1 + s_suppkey % 4 AS project_id, s_name AS name, {_PARENT} AS parent, CASE WHEN s_suppkey % 7 = 0 THEN 'Globex' ELSE {_PARENT} END AS f, {_MOVE} AS t FROM supplier WHERE {_IS_SUB}),
r AS (SELECT *, CASE WHEN f = t THEN '' WHEN f <> parent THEN 'no such sub-brand' WHEN t = 'Nobody' THEN 'unknown parent' ELSE 'moved' END AS what FROM m)
SELECT project_id, name, CASE what WHEN 'moved' THEN t ELSE parent END AS state, CASE what WHEN 'moved' THEN 0 ELSE 1 END::INT AS n_aliases FROM r UNION ALL SELECT project_id, name, 'refused: ' || what, 0 FROM r WHERE what NOT IN ('', 'moved')""",
    "sub_brand_reset": f"""WITH {_ENTS}, {_SUBS}, u AS (SELECT e.project_id, e.id FROM ents e JOIN subs s USING (project_id, name))
SELECT e.id, CASE WHEN p.id IS NULL THEN e.alias_of END AS alias_of, CASE WHEN p.id IS NOT NULL OR o.id IS NOT NULL THEN 'confirmed' ELSE e.status END AS status, true AS cleared
FROM ents e LEFT JOIN u p ON p.id = e.alias_of AND p.project_id = e.project_id LEFT JOIN u o ON o.id = e.id""",
    "scenario_renames": f"""WITH {_TREE}, g AS (SELECT * FROM q WHERE reason IS NULL), n AS (SELECT 1 + p_size % 4 AS project_id, p_brand AS name, count(*) AS prompts FROM part GROUP BY ALL)
SELECT s.project_id, coalesce(g.new_name, s.name) AS name, coalesce(h.new_name, s.parent, '') AS detail, coalesce(prompts, 0) AS prompts FROM s LEFT JOIN g USING (project_id, name) LEFT JOIN g h ON h.project_id = s.project_id AND h.name = s.parent LEFT JOIN n ON n.project_id = s.project_id AND n.name = s.name
UNION ALL SELECT project_id, name, 'refused: ' || reason, 0 FROM q WHERE reason IS NOT NULL""",
    "suggestion_checks": f"""WITH {_ENTS} SELECT project_id, s_name AS entity, 'Acme' AS parent, CASE WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence
FROM supplier JOIN ents ON ents.id = s_suppkey WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 2 AND ents.name = s_name""",
    "consolidation_counters": f"""WITH RECURSIVE {_ROOTS}, c AS (SELECT root, count(*) AS n FROM roots GROUP BY 1)
SELECT count(*) AS clusters, (sum(n) - count(*))::BIGINT AS merged, count(*) FILTER (root % 5 IN (0, 1)) AS brand, count(*) FILTER (root % 5 IN (2, 3)) AS competitor, count(*) FILTER (root % 5 = 4) AS discovered FROM c""",
}
