"""Write-back of resolved entities: roots, split clusters, answer flags, entity table and alias edges. All set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_clusters(members: DataFrame) -> DataFrame:
    """(name, cluster) from (name, leader, roots array): clusters that mix known roots are split.

    A cluster stays whole if no member has exactly one root, or if all its roots are one and every member has it. Else members with one root go by
    root, and the others stand alone.
    """
    w = Window.partitionBy("leader")
    single = F.when(F.size("roots") == 1, F.col("roots")[0])
    m = members.withColumn("root", single)
    m = m.withColumns({"low": F.min("root").over(w), "high": F.max("root").over(w), "bare": F.count_if(F.col("root").isNull()).over(w)})
    whole = F.col("low").isNull() | ((F.col("low") == F.col("high")) & (F.col("bare") == 0))
    return m.select("name", F.when(whole, F.concat(F.lit("c:"), "leader")).when(F.col("root").isNotNull(), F.concat(F.lit("r:"), "leader", F.lit("|"), "root")).otherwise(F.concat(F.lit("n:"), "name")).alias("cluster"))


def rebuild_flags(answers: DataFrame, mentions: DataFrame, known: DataFrame, brand: str) -> DataFrame:
    """(answer_id, brand_mentioned, competitor_mentions): every known key false but those matched; a sub-brand's parent counts too.

    answers (answer_id), mentions (answer_id, key), known (key).
    """
    parent = F.when(F.col("key").contains("::"), F.split("key", "::")[0])
    m = mentions.select("answer_id", F.explode(F.array_compact(F.array("key", parent))).alias("key"))
    keys = m.groupBy("answer_id").agg(F.collect_set("key").alias("keys"))
    every = known.where(F.col("key") != brand).agg(F.array_sort(F.collect_set("key")).alias("every"))  # the project's list, one row
    out = answers.join(keys, "answer_id", "left").join(F.broadcast(every))
    has = lambda k: F.coalesce(F.array_contains("keys", k), F.lit(False))
    return out.select("answer_id", has(F.lit(brand)).alias("brand_mentioned"), F.map_from_arrays("every", F.transform("every", has)).alias("competitor_mentions"))


def rewrite_entities(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Entity table after a day: counts replaced by delta's, first and last seen widened, curated rows keep their status.

    state and delta: (name, status, mentions, first_seen, last_seen).
    """
    d = delta.select(*[F.col(c).alias("_" + c) for c in delta.columns])
    out = state.join(d, F.col("name") == F.col("_name"), "full")
    curated = F.col("status").isin("promoted", "rejected", "alias")
    return out.select(
        F.coalesce("name", "_name").alias("name"), F.when(curated, F.col("status")).otherwise(F.coalesce("_status", "status")).alias("status"), F.coalesce("_mentions", "mentions").alias("mentions"),
        F.least("first_seen", "_first_seen").alias("first_seen"), F.greatest("last_seen", "_last_seen").alias("last_seen"),
    )


def dash_merge(entities: DataFrame, key: Column) -> DataFrame:
    """Variants of one key folded into the most frequent spelling: (canonical, mentions, variants)."""
    pick = F.min(F.struct((-F.col("mentions")).alias("m"), F.length("name").alias("n"), F.col("name").alias("name")))
    g = entities.groupBy(key.alias("_k")).agg(pick.alias("p"), F.sum("mentions").alias("mentions"), F.array_sort(F.collect_set("name")).alias("names"))
    return g.select(F.col("p.name").alias("canonical"), "mentions", F.array_except("names", F.array("p.name")).alias("variants"))


def with_aliases(entities: DataFrame) -> DataFrame:
    """(id, name, own, with_aliases) from (id, name, alias_of, mentions): roots with their aliases' counts."""
    alias = entities.where("alias_of is not null").groupBy(F.col("alias_of").alias("id")).agg(F.sum("mentions").alias("more"))
    return entities.where("alias_of is null").join(alias, "id", "left").select("id", "name", F.col("mentions").alias("own"), (F.col("mentions") + F.coalesce("more", F.lit(0))).alias("with_aliases"))


def repoint_aliases(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Alias edges after merges (source, target): sources become aliases of their target and their aliases follow; depth stays one."""
    m = merges.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    own = entities.join(m, F.col("id") == F.col("_s"), "left").withColumn("alias_of", F.coalesce("_t", "alias_of")).drop("_s", "_t")
    return own.join(m, F.col("alias_of") == F.col("_s"), "left").withColumn("alias_of", F.coalesce("_t", "alias_of")).drop("_s", "_t")


def set_status(state: DataFrame, ids: DataFrame, status: str, key: str = "name") -> DataFrame:
    """State with the rows of a key list set to a status."""
    hit = ids.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    return state.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def promoted(entities: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names to add to the competitor list, promoted rows that the list lacks): the two differences of the same sets."""
    p = entities.where("status = 'promoted'").select("name")
    return known.join(p, "name", "left_anti"), p.join(known, "name", "left_anti")


def known_matches(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, key, root, priority) of every name and the known names that it matches or equals.

    names (name); known (name, key, root, priority): own brand first, then its sub-brands, competitors and theirs.
    """
    from sightline.operators.entities import name_forms, pairs

    k = known.select(F.col("name").alias("_k"), "key", "root", "priority")
    found = pairs(name_forms(names.select("name").unionByName(known.select("name"))))
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    equal = names.select(F.col("name").alias("a"), F.col("name").alias("b")).distinct()
    m = both.join(names.select(F.col("name").alias("a")).distinct(), "a", "left_semi").unionByName(equal)
    return m.join(k, F.col("b") == F.col("_k")).select(F.col("a").alias("name"), "key", "root", "priority").distinct()


def roots(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, roots array): known roots of each name; none is an empty array."""
    r = known_matches(names, known).groupBy("name").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    return names.select("name").distinct().join(r, "name", "left").select("name", F.coalesce("roots", F.array().cast("array<string>")).alias("roots"))


def cluster_keys(clusters: DataFrame, known: DataFrame) -> DataFrame:
    """(cluster, key): the first known key, by priority then key, that any member of a cluster matches; null where none does."""
    m = known_matches(clusters.select("name"), known)
    best = clusters.join(m, "name").groupBy("cluster").agg(F.min(F.struct("priority", "key")).alias("p"))
    return clusters.select("cluster").distinct().join(best, "cluster", "left").select("cluster", F.col("p.key").alias("key"))


def fresh_profiles(mentions: DataFrame, cache: DataFrame, asof: str, days: int = 7) -> DataFrame:
    """mentions (entity_key, ...) with is_fresh: a cached profile (entity_key, updated_at) not older than so many days."""
    c = cache.groupBy("entity_key").agg(F.max("updated_at").alias("updated_at"))
    fresh = F.coalesce(F.col("updated_at") >= F.date_sub(F.lit(asof).cast("date"), days), F.lit(False))
    return mentions.join(c, "entity_key", "left").withColumn("is_fresh", fresh)


def apply_verdicts(entities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Entities (name, status) with verdict rows (name, alias_of, parent, is_competitor) applied: alias, then sub-brand, then competitor, else rejected."""
    v = verdicts.select(F.col("name").alias("_n"), "alias_of", "parent", "is_competitor")
    status = F.when(F.col("alias_of").isNotNull(), "alias").when(F.col("parent").isNotNull(), "sub_brand").when(F.col("is_competitor"), "promoted").otherwise("rejected")
    out = entities.join(v, F.col("name") == F.col("_n"), "left")
    return out.withColumn("status", F.when(F.col("_n").isNotNull(), status).otherwise(F.col("status"))).drop("_n", "is_competitor")


def embedding_guard(groups: DataFrame, least: float = 0.70) -> DataFrame:
    """(name, cluster) from (cluster, rank, name, v): in rank order a member stays if its largest cosine to a member kept before is at least `least`,
    else it stands alone; members without a vector stay. Groups are the small fuzzy clusters of names."""
    import numpy as np
    import pandas as pd

    def guard(g: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for name, v in g.sort_values("rank")[["name", "v"]].itertuples(index=False):
            u = None
            if v is not None and np.linalg.norm(v) > 0:
                u = np.asarray(v, float) / np.linalg.norm(v)
            stays = u is None or not kept or max(float(u @ k) for k in kept) >= least
            if u is not None and stays:
                kept.append(u)
            out.append((name, g["cluster"].iloc[0] if stays else f"n:{name}"))
        return pd.DataFrame(out, columns=["name", "cluster"])

    return groups.groupBy("cluster").applyInPandas(guard, "name string, cluster string")
