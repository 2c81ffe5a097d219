"""Aliases, sub-brands and scenarios as edges: chains followed to their ends, counts rolled up on three levels, and edits that carry over to what hangs below.

Tables are of one schema throughout: entities (project_id, id, name, status, alias_of, mentions, suggested_parent), where alias_of is the id of another entity of the
project; subs (project_id, parent, name, aliases), the sub-brands of a project's brand and of its competitors; scenarios (project_id, name, parent).
Edits that cannot be made are returned beside the result with a reason, and change nothing. Names of one project are unique; null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.sources.shared import written


def chain_ends(edges: DataFrame, node: str = "id", to: str = "alias_of") -> DataFrame:
    """(node, root, cyclic): the end of each node's chain. A node that points to none, or to one that is not there, is its own end; a chain that runs
    into a circle ends at the circle's smallest node.

    Pointers are doubled by joins, so a chain of n links takes log2(n) rounds; after as many rounds as the number of nodes has bits, what has not ended
    stands on a circle, and the smallest node of a walk of that length is the circle's.
    """
    e = edges.select(F.col(node).alias("node"), F.col(to).alias("next")).where("node is not null").dropDuplicates(["node"])
    there = e.select(F.col("node").alias("t"))
    t = e.join(there, F.col("next") == F.col("t"), "left").select("node", F.coalesce("t", "node").alias("p"), F.col("t").isNull().alias("end"))
    t = written(t.withColumn("low", F.col("node")), "pointers")
    rounds = max(1, t.count().bit_length())
    for _ in range(rounds):
        ahead = t.select(F.col("node").alias("p"), F.col("p").alias("q"), F.col("end").alias("stop"), F.col("low").alias("l"))
        open_ = t.where("not end")
        if open_.isEmpty():
            break
        # a pointer at an end is done
        moved = open_.join(ahead, "p").select("node", F.col("q").alias("p"), F.col("stop").alias("end"), F.least("low", "l").alias("low"))
        t = written(t.where("end").unionByName(moved), "pointers")
    low = t.select(F.col("node").alias("p"), F.col("low").alias("circle"))
    return t.join(low, "p").select(F.col("node"), F.when(F.col("end"), F.col("p")).otherwise(F.col("circle")).alias("root"), (~F.col("end")).alias("cyclic"))


def totals_by_root(entities: DataFrame) -> DataFrame:
    """(root, own, total, members): mentions of the entity at the end of each chain, and of all entities whose chains end there."""
    ends = chain_ends(entities).select(F.col("node").alias("id"), "root")
    d = entities.join(ends, "id")
    return d.groupBy("root").agg(F.coalesce(F.sum(F.when(F.col("id") == F.col("root"), F.col("mentions"))), F.lit(0)).alias("own"), F.sum("mentions").alias("total"), F.count("*").alias("members"))


def mention_totals(counts: DataFrame, tracked: DataFrame, subs: DataFrame, entities: DataFrame) -> DataFrame:
    """(project_id, name, own, with_aliases, total) of each tracked brand: its answers; with its aliases' mentions; and with its sub-brands' answers and their aliases' mentions.

    counts: (project_id, key, n), answers by the key of a competitor map, where a sub-brand is parent::name. tracked: (project_id, name, key).
    """
    alias = entities.where("alias_of is not null").groupBy("project_id", F.col("alias_of").alias("id")).agg(F.sum("mentions").alias("more"))
    more = entities.join(alias, ["project_id", "id"]).groupBy("project_id", "name").agg(F.sum("more").alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    own = tracked.join(counts, ["project_id", "key"], "left").join(more, ["project_id", "name"], "left").select("project_id", "name", "key", zero("n").alias("own"), zero("more").alias("more"))
    s = subs.join(tracked.select("project_id", F.col("name").alias("parent"), F.col("key").alias("over")), ["project_id", "parent"]).withColumn("key", F.concat_ws("::", "over", "name"))
    s = s.join(counts, ["project_id", "key"], "left").join(more, ["project_id", "name"], "left").groupBy("project_id", F.col("parent").alias("name")).agg(F.sum(zero("n") + zero("more")).alias("below"))
    return own.join(s, ["project_id", "name"], "left").select("project_id", "name", "own", (F.col("own") + F.col("more")).alias("with_aliases"), (F.col("own") + F.col("more") + zero("below")).alias("total"))


def reset_seen(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """Entities whose alias edges are taken back where their names were seen (project_id, name): they are pending again. Others keep theirs."""
    hit = seen.select("project_id", "name").distinct().withColumn("_seen", F.lit(True))
    back = (F.col("status") == "alias") & F.coalesce(F.col("_seen"), F.lit(False))
    d = entities.join(hit, ["project_id", "name"], "left").withColumn("_back", F.coalesce(back, F.lit(False)))
    return d.select(*(F.when(F.col("_back"), {"alias_of": F.lit(None), "status": F.lit("pending")}[c]).otherwise(F.col(c)).alias(c) if c in ("alias_of", "status") else F.col(c) for c in entities.columns))


def enriched(subs: DataFrame, entities: DataFrame) -> DataFrame:
    """Sub-brands with the names of their entities' aliases among their aliases, sorted and distinct."""
    of = entities.select("project_id", "name", "id").join(entities.select("project_id", F.col("alias_of").alias("id"), F.col("name").alias("alias")), ["project_id", "id"])
    more = of.groupBy("project_id", "name").agg(F.collect_set("alias").alias("more"))
    none = F.array().cast("array<string>")
    d = subs.join(more, ["project_id", "name"], "left")
    return d.select("project_id", "parent", "name", F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("more", none))).alias("aliases"))


def move_subs(subs: DataFrame, moves: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subs, refused) after moves (project_id, name, from_parent, to_parent): a moved sub-brand loses its own aliases, as those of its entity follow it.
    Refused: no such sub-brand there, or an unknown parent (project_id, name). A move to where it is changes nothing."""
    m = moves.dropDuplicates(["project_id", "name"])
    m = m.join(subs.select("project_id", F.col("parent").alias("from_parent"), "name", F.lit(True).alias("here")), ["project_id", "from_parent", "name"], "left")
    m = m.join(parents.select("project_id", F.col("name").alias("to_parent"), F.lit(True).alias("known")), ["project_id", "to_parent"], "left")
    why = F.when(F.col("from_parent") == F.col("to_parent"), None).when(F.col("here").isNull(), "no such sub-brand").when(F.col("known").isNull(), "unknown parent")
    m = m.withColumn("reason", why)
    good = m.where("reason is null and from_parent <> to_parent").select("project_id", F.col("from_parent").alias("parent"), "name", "to_parent")
    d = subs.join(good, ["project_id", "parent", "name"], "left")
    moved = F.col("to_parent").isNotNull()
    out = d.select("project_id", F.coalesce("to_parent", "parent").alias("parent"), "name", F.when(moved, F.array().cast("array<string>")).otherwise(F.col("aliases")).alias("aliases"))
    return out, m.where("reason is not null").select("project_id", "name", "reason")


def reset_subs(entities: DataFrame, subs: DataFrame) -> DataFrame:
    """Entities after all sub-brands of their projects are given up: those of sub-brands are confirmed, their aliases are confirmed and no aliases any
    more, and no entity has a suggested parent. Projects without sub-brands lose their suggestions too."""
    named = subs.select("project_id", "name").distinct()
    ids = entities.join(named, ["project_id", "name"]).select("project_id", F.col("id").alias("alias_of"), F.lit(True).alias("_under")).distinct()
    d = entities.join(named.withColumn("_sub", F.lit(True)), ["project_id", "name"], "left").join(ids, ["project_id", "alias_of"], "left")
    new = {
        "status": F.when(F.col("_sub") | F.col("_under"), "confirmed").otherwise(F.col("status")),
        "alias_of": F.when(F.col("_under"), None).otherwise(F.col("alias_of")),
        "suggested_parent": F.lit(None).cast("string"),
    }
    return d.select(*(new.get(c, F.col(c)).alias(c) for c in entities.columns))


def rename_scenarios(scenarios: DataFrame, rows: DataFrame, renames: DataFrame, category: str = "category") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenarios, rows, refused) after renames (project_id, name, new_name): children and rows follow their scenario.
    Refused: no such scenario, a name that is taken, or one that two renames want."""
    r = renames.where("name <> new_name").dropDuplicates(["project_id", "name"])
    r = r.join(scenarios.select("project_id", "name", F.lit(True).alias("here")), ["project_id", "name"], "left")
    r = r.join(scenarios.select("project_id", F.col("name").alias("new_name"), F.lit(True).alias("taken")), ["project_id", "new_name"], "left")
    wanted = r.groupBy("project_id", "new_name").agg(F.count("*").alias("wanted"))
    r = r.join(wanted, ["project_id", "new_name"]).withColumn("reason", F.when(F.col("here").isNull(), "no such scenario").when(F.col("taken"), "name taken").when(F.col("wanted") > 1, "wanted twice"))
    good = written(r.where("reason is null").select("project_id", F.col("name").alias("_old"), F.col("new_name").alias("_new")), "renames")

    def follow(d: DataFrame, c: str) -> DataFrame:
        g = good.withColumnRenamed("project_id", "_project")
        return d.join(g, (F.col("project_id") == F.col("_project")) & (F.col(c) == F.col("_old")), "left").withColumn(c, F.coalesce("_new", c)).drop("_project", "_old", "_new")

    return follow(follow(scenarios, "name"), "parent"), follow(rows, category), r.where("reason is not null").select("project_id", "name", "new_name", "reason")


def set_parents(scenarios: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenarios, refused) after edits (project_id, name, parent): a null parent makes a top scenario. Refused: an unknown scenario or parent, or its own parent.
    Edits that close a circle together are refused as well, all that lie on it or lead into it."""
    e = edits.dropDuplicates(["project_id", "name"]).select("project_id", "name", F.col("parent").alias("new"))
    e = e.join(scenarios.select("project_id", "name", F.lit(True).alias("here")), ["project_id", "name"], "left")
    e = e.join(scenarios.select("project_id", F.col("name").alias("new"), F.lit(True).alias("known")), ["project_id", "new"], "left")
    why = F.when(F.col("here").isNull(), "no such scenario").when(F.col("name") == F.col("new"), "own parent").when(F.col("new").isNotNull() & F.col("known").isNull(), "unknown parent")
    e = written(e.select("project_id", "name", "new", why.alias("reason")), "edits")
    key = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col("project_id").alias("p"), F.col(c).alias("n"))))

    def edited(bad: DataFrame | None) -> DataFrame:
        good = e.where("reason is null").select("project_id", "name", "new", F.lit(True).alias("edit"))
        if bad is not None:
            good = good.join(bad, ["project_id", "name"], "left_anti")
        return scenarios.join(good, ["project_id", "name"], "left").withColumn("parent", F.when(F.col("edit"), F.col("new")).otherwise(F.col("parent")))

    tree = edited(None).select("project_id", "name", key("name").alias("id"), key("parent").alias("to"))
    cyclic = written(chain_ends(tree, "id", "to").where("cyclic").select(F.col("node").alias("id")).join(tree, "id").select("project_id", "name"), "cyclic")
    refused = e.where("reason is not null").select("project_id", "name", "reason")
    circles = e.where("reason is null").join(cyclic, ["project_id", "name"]).select("project_id", "name", F.lit("circle").alias("reason"))
    return edited(cyclic).select(*scenarios.columns), refused.unionByName(circles)


def unquoted(name: Column) -> Column:
    """A name without backslashes and quotes, trimmed."""
    return F.trim(F.regexp_replace(name, r"""[\\"']""", ""))


def valid_suggestions(suggestions: DataFrame, entities: DataFrame, parents: DataFrame) -> DataFrame:
    """(project_id, entity, parent, confidence) of suggestions whose entity is known, as it is or without its quotes, and whose parent is; confidence is medium where it
    is missing. Of several entities that are one without quotes, the last by id is meant."""
    s = suggestions.withColumn("_n", F.monotonically_increasing_id())
    exact = entities.select("project_id", F.col("name").alias("entity"), F.col("name").alias("_exact")).distinct()
    bare = entities.groupBy("project_id", unquoted(F.col("name")).alias("_bare")).agg(F.max_by("name", "id").alias("_loose"))
    d = s.join(exact, ["project_id", "entity"], "left").withColumn("_bare", unquoted(F.col("entity"))).join(bare, ["project_id", "_bare"], "left")
    d = d.join(parents.select("project_id", F.col("name").alias("parent")).distinct(), ["project_id", "parent"])
    return d.withColumn("entity", F.coalesce("_exact", "_loose")).where("entity is not null").select("project_id", "entity", "parent", F.coalesce("confidence", F.lit("medium")).alias("confidence"))


def consolidation_summary(clusters: DataFrame) -> DataFrame:
    """One row of counters over clusters (cluster, name, key): clusters, names merged into others, and clusters of the brand, of competitors and of none.
    key is that of the known name a cluster belongs to: __brand__ and its sub-brands are the brand's."""
    c = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.first("key").alias("key"))
    brand = (F.col("key") == "__brand__") | F.col("key").startswith("__brand__::")
    return c.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged"), F.count_if(brand).alias("brand"), F.count_if(~brand).alias("competitor"), F.count_if(F.col("key").isNull()).alias("discovered"))
