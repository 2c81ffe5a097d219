"""Entity resolution at scale: candidate pairs by keys that lose no match, exact verification, leader clusters by rounds of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.names import forms, sounds, spelled
from sightline.sources.shared import written


def name_forms(names: DataFrame, name: str = "name") -> DataFrame:
    """One row per distinct name with all its match forms, computed once."""
    d = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    return d.withColumns(forms(F.col("name")))


def keys() -> Column:
    """Blocking keys: any two names that match share one. Each rule has its own kind of key."""
    k = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    grams = lambda kind, c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: k(kind, F.substr(c, i, F.lit(3))))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length("skel"), F.lit(1))), lambda i: k("p", F.concat(F.substr("skel", F.lit(1), i - 1), F.substr("skel", i + 1))))
    long_skel = F.length("skel") >= 4
    return F.array_distinct(F.array_compact(F.concat(
        F.array(k("n", F.col("norm")), k("l", F.col("lat")), k("c", F.col("cyr")), k("s", F.col("syn")), F.when(F.col("bare") != "", k("n", F.col("bare"))), F.when(F.col("bare_lat") != "", k("b", F.col("bare_lat"))),
                F.when(F.length("lat") >= 4, k("4", F.left("lat", F.lit(4)))), F.when(long_skel, k("p", F.col("skel")))),
        F.when(long_skel, cut).otherwise(F.array().cast("array<string>")), grams("g", F.col("norm")), grams("h", F.col("lat")),
    )))


def classes(table: DataFrame) -> DataFrame:
    """Names of a form table with all forms alike as one row: name (the smallest), n and the forms. Such names match one another, and the same others."""
    same = [c for c in table.columns if c != "name"]
    return table.groupBy(*same).agg(F.min("name").alias("name"), F.count("*").alias("n")).select("name", "n", *same)


def members(table: DataFrame, of: DataFrame) -> DataFrame:
    """(name, of): every name of a form table with the one that stands for its class."""
    same = [c for c in table.columns if c != "name"]
    other = of.select(F.col("name").alias("of"), *(F.col(c).alias(f"c_{c}") for c in same))
    alike = [F.col("norm") == F.col("c_norm"), *(F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in same if c != "norm")]
    return table.join(other, reduce(lambda x, y: x & y, alike)).select("name", "of")


#: Names up to this long offer all the parts that others may be; longer ones are looked up by their rarest piece of PIECE characters.
LONG, PIECE = 64, 16
#: Pairs of one pair of sound groups that a task makes at most, about.
PAIRS = 1 << 22


def candidates(t: DataFrame) -> DataFrame:
    """(a, b) with a < b of names of a form table that may match by a rule other than sound: all that do are among them, and names that only begin alike are not.

    Equal forms meet as they are. For prefixes, a name looks its whole Latin form up among the beginnings of others that it is long enough for, and for containment its
    forms among the parts of others that are long enough: some 0.045 n^2 parts of n characters. Where the other is longer than LONG, it looks its rarest piece up among all of its pieces.
    """
    k = lambda kind, c: F.xxhash64(F.lit(kind), c)
    both = lambda x, y: x.select("key", F.col("name").alias("a")).join(y.select("key", F.col("name").alias("b")), "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    equal = F.array(k("n", F.col("norm")), k("l", F.col("lat")), k("c", F.col("cyr")), k("s", F.col("syn")), F.when(F.col("bare") != "", k("n", F.col("bare"))), F.when(F.col("bare_lat") != "", k("b", F.col("bare_lat"))))
    same = t.select("name", F.explode(F.array_distinct(F.array_compact(equal))).alias("key"))

    n = F.length("lat")
    begins = F.when(n >= 4, F.transform(F.sequence(F.greatest(F.lit(4), F.ceil(n * 0.4).cast("int")), n), lambda i: k("4", F.left("lat", i))))
    starts = t.select("name", F.explode(begins).alias("key"))
    whole = t.where(n >= 4).select("name", k("4", F.col("lat")).alias("key"))

    def parts(c: str) -> Column:
        """Proper parts of at least 0.7 of a form."""
        n = F.length(c)
        lengths = F.when((n > 1) & (n <= LONG), F.sequence(F.ceil(n * 0.7).cast("int"), n - 1)).otherwise(F.array().cast("array<int>"))
        lengths = F.filter(lengths, lambda i: i < n)
        return F.flatten(F.transform(lengths, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda at: k(c, F.substr(c, at, i)))))

    inside = t.select("name", F.explode(F.array_distinct(F.concat(parts("norm"), parts("lat")))).alias("key"))
    forms_ = t.select("name", F.explode(F.array(k("norm", F.col("norm")), k("lat", F.col("lat")))).alias("key"))

    pieces = lambda c: F.when(F.length(c) >= LONG * 0.7, F.transform(F.sequence(F.lit(1), F.length(c) - PIECE + 1), lambda i: k(c, F.substr(c, i, F.lit(PIECE))))).otherwise(F.array().cast("array<bigint>"))
    form = lambda c: t.where(F.length(c) >= LONG * 0.7).select("name", F.lit(c).alias("kind"), F.length(c).alias("n"), F.explode(F.array_distinct(pieces(c))).alias("key"))
    every = written(form("norm").unionByName(form("lat")), "pieces")
    often = every.groupBy("key").agg(F.count("*").alias("often"))
    rarest = every.join(often, "key").groupBy("name", "kind").agg(F.min_by("key", F.struct("often", "key")).alias("key"))
    return both(same, same).unionByName(both(whole, starts)).unionByName(both(forms_, inside)).unionByName(both(rarest, every.where(F.col("n") > LONG))).distinct()


def sound_groups(t: DataFrame) -> DataFrame:
    """(name, grp): the names of a form table that can sound like others by script and skeleton, which alone decide whether names sound alike."""
    script = F.when(F.col("has_lat") & ~F.col("has_cyr"), "l").when(F.col("has_cyr") & ~F.col("has_lat"), "c").otherwise("m")
    return t.where(F.length("skel") >= 4).select("name", F.concat_ws(":", script, "skel").alias("grp"))


def sound_links(groups: DataFrame) -> DataFrame:
    """(g, h), in both directions, of the sound groups whose names sound alike: all names of the one with all of the other. A group of both scripts does with itself.

    A group looks its skeleton up, whole and with a letter left out, among groups of another script.
    """
    g = groups.select("grp").distinct().select("grp", F.left("grp", F.lit(1)).alias("script"), F.substr("grp", F.lit(3)).alias("skel"))
    cuts = F.transform(F.sequence(F.lit(1), F.length("skel")), lambda i: F.concat(F.substr("skel", F.lit(1), i - 1), F.substr("skel", i + 1)))
    keyed = g.select("grp", "script", "skel", F.explode(F.array_distinct(F.concat(F.array("skel"), cuts))).alias("key"))
    others = F.when(F.col("script") == "l", F.array(F.lit("c"), F.lit("m"))).otherwise(F.array(F.lit("m")))
    asks = keyed.select(F.col("grp").alias("g"), F.col("skel").alias("x"), "key", F.explode(others).alias("script"))
    met = asks.join(keyed.select(F.col("grp").alias("h"), F.col("skel").alias("y"), "key", "script"), ["key", "script"])
    alike = (F.col("x") == F.col("y")) | ((F.least(F.length("x"), F.length("y")) >= 5) & (F.levenshtein("x", "y", 1) != -1))
    one = met.where(alike).select("g", "h")
    return one.unionByName(one.select(F.col("h").alias("g"), F.col("g").alias("h"))).distinct()


def spelled_pairs(of: DataFrame) -> DataFrame:
    """(a, b, sound) with a < b of the classes of names that match by a rule other than sound, and whether they sound alike as well."""
    t = written(of, "classes")
    side = lambda p: t.select(F.col("name").alias(p[0]), *[F.col(c).alias(p + c) for c in t.columns if c not in ("name", "n")])
    return candidates(t).join(side("a_"), "a").join(side("b_"), "b").where(spelled()).select("a", "b", sounds().alias("sound"))


def pairs(table: DataFrame) -> DataFrame:
    """(a, b) with a < b of all matching names of a form table: pairs of classes and of sound groups, expanded.

    Names of two groups that sound alike are all pairs; the tasks that make them share the first group's names, PAIRS pairs each.
    """
    of = written(classes(table), "classes")
    m = written(members(table, of), "members")
    mine = lambda c: m.select(F.col("name").alias(f"n{c}"), F.col("of").alias(c))
    between = spelled_pairs(of).where("not sound").join(mine("a"), "a").join(mine("b"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    within = mine("a").join(m.select("name", F.col("of").alias("a")), "a").where("na < name").select(F.col("na").alias("a"), F.col("name").alias("b"))

    s = written(m.join(sound_groups(of).withColumnRenamed("name", "of"), "of"), "sounds")
    size = s.groupBy("grp").agg(F.count("*").alias("size"))
    of_group = lambda c: size.select(F.col("grp").alias(c), F.col("size").alias(f"s{c}"))
    split = sound_links(s).join(of_group("g"), "g").join(of_group("h"), "h").select("g", "h", F.ceil(F.col("sg") * F.col("sh") / PAIRS).cast("int").alias("parts"))
    split = written(split, "split")
    asks = s.select(F.col("name").alias("a"), F.col("of").alias("oa"), F.col("grp").alias("g")).join(split, "g").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    offers = s.select(F.col("name").alias("b"), F.col("of").alias("ob"), F.col("grp").alias("h")).join(split, "h").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    alike = asks.select("g", "h", "part", "a", "oa").join(offers.select("g", "h", "part", "b", "ob"), ["g", "h", "part"]).where("a < b and oa <> ob").select("a", "b")
    return between.unionByName(within).unionByName(alike)


def links(table: DataFrame) -> DataFrame:
    """(name, of, links): each name with the one that stands for its class, and how many other names it matches; no pair of members is made, and none of names that
    sound alike: those are counted by groups."""
    of = written(classes(table), "classes")
    p = written(spelled_pairs(of).where("not sound").select("a", "b"), "pairs")
    n = of.select(F.col("name").alias("b"), "n")
    out = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(n, "b").groupBy("a").agg(F.sum("n").alias("out"))
    groups = written(sound_groups(of).join(of.select("name", "n"), "name"), "sounds")
    size = groups.groupBy(F.col("grp").alias("h")).agg(F.sum("n").alias("size"))
    near = sound_links(groups).join(size, "h").groupBy("g").agg(F.sum("size").alias("near"), F.bool_or(F.col("g") == F.col("h")).alias("own"))
    near = groups.join(near, F.col("grp") == F.col("g")).select("name", (F.col("near") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("near"))
    count = of.join(out, F.col("name") == F.col("a"), "left").join(near, "name", "left").select(F.col("name").alias("of"), (F.coalesce("out", F.lit(0)) + F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members(table, of).join(count, "of").select("name", "of", "links")


def ranked_leaders(table: DataFrame, ranks: DataFrame) -> DataFrame:
    """(name, leader) as leaders() gives it for the matching names of a form table and ranks (name, rank), found between classes: the first name of a class goes
    where it would alone, and the others go with it."""
    of = written(classes(table), "classes")
    m = written(members(table, of).join(ranks, "name"), "members")
    first = written(m.groupBy("of").agg(F.min_by("name", "rank").alias("first"), F.min("rank").alias("rank")), "firsts")
    to = lambda d, c: d.join(first.select(F.col("of").alias(c), F.col("first").alias(f"f{c}")), c)
    edges = written(to(to(spelled_pairs(of).select("a", "b"), "a"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")), "edges")
    groups = written(to(sound_groups(of).withColumnRenamed("name", "of"), "of").select(F.col("fof").alias("name"), "grp"), "sounds")
    led = leaders(first.select(F.col("first").alias("name"), "rank"), edges, groups, written(sound_links(groups), "links"))
    return m.join(first.select("of", "first"), "of").join(led.select(F.col("name").alias("first"), "leader"), "first").select("name", "leader")


def leaders(nodes: DataFrame, edges: DataFrame, groups: DataFrame | None = None, group_links: DataFrame | None = None) -> DataFrame:
    """(name, leader): greedy clusters in rank order. nodes: (name, rank), unique ranks; edges: (a, b) in any direction.

    groups (name, grp) and group_links (g, h), in both directions, stand for edges between all names of two groups, which are never listed: a name has
    an earlier leader there where the earliest of the group is earlier.

    A node leads if no earlier leader matches it; others join their earliest matching leader. Rounds of joins settle every node whose earlier
    neighbours are settled; the number of rounds is that of the longest chain of dependencies, short in practice.
    """
    n = nodes.select("name", "rank")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    r = both.join(n.select(F.col("name").alias("a"), F.col("rank").alias("ra")), "a").join(n.select(F.col("name").alias("b"), F.col("rank").alias("rb")), "b")
    earlier = written(r.where("rb < ra").select("a", "b", "rb"), "earlier")
    state = written(n.withColumn("leads", F.lit(None).cast("boolean")), "state")

    def by_groups(state: DataFrame) -> DataFrame:
        """(name, first, open): of the groups that a name's group is linked to, the first leader (rank, name) and the lowest rank that is not settled."""
        best = F.min(F.when(F.col("leads"), F.struct("rank", "name"))).alias("first")
        of = groups.join(state, "name").groupBy(F.col("grp").alias("h")).agg(best, F.min(F.when(F.col("leads").isNull(), F.col("rank"))).alias("open"))
        near = group_links.join(of, "h").groupBy("g").agg(F.min("first").alias("first"), F.min("open").alias("open_rank"))
        return groups.join(near, F.col("grp") == F.col("g")).select("name", "first", "open_rank")

    while True:
        s = state.select(F.col("name").alias("b"), F.col("leads").alias("bl"))
        seen = earlier.join(s, "b").groupBy("a").agg(F.bool_or(F.coalesce("bl", F.lit(False))).alias("led"), F.count_if(F.col("bl").isNull()).alias("open"))
        led, open_ = F.coalesce("led", F.lit(False)), F.coalesce("open", F.lit(0)) > 0
        d = state.join(seen, F.col("name") == F.col("a"), "left")
        if groups is not None:
            d = d.join(by_groups(state), "name", "left")
            led, open_ = led | F.coalesce(F.col("first.rank") < F.col("rank"), F.lit(False)), open_ | F.coalesce(F.col("open_rank") < F.col("rank"), F.lit(False))
        state = written(d.select("name", "rank", F.when(F.col("leads").isNotNull(), F.col("leads")).when(led, False).when(~open_, True).alias("leads")), "state")
        if state.where("leads is null").isEmpty():
            break
    first = earlier.join(state.where("leads").select(F.col("name").alias("b")), "b", "left_semi").select("a", F.struct(F.col("rb").alias("rank"), F.col("b").alias("name")).alias("first"))
    if groups is not None:
        first = first.unionByName(by_groups(state).where("first is not null").select(F.col("name").alias("a"), "first"))
    first = first.groupBy("a").agg(F.min_by("first.name", "first.rank").alias("leader"))
    return state.join(first, F.col("name") == F.col("a"), "left").select("name", F.when(F.col("leads"), F.col("name")).otherwise(F.col("leader")).alias("leader"))


def canonical(members: DataFrame) -> DataFrame:
    """(leader, canonical, total) from (name, leader, freq): most frequent, then shortest, then first name."""
    pick = F.min(F.struct((-F.col("freq")).alias("f"), F.length("name").alias("n"), F.col("name").alias("name")))
    return members.groupBy("leader").agg(pick.alias("p"), F.sum("freq").alias("total")).select("leader", F.col("p.name").alias("canonical"), "total")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1.0 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
