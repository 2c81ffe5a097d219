"""Brands in answers: many names and aliases of many projects at once, as joins on what texts and names share.

names has a row for each name of a brand: (project, brand, role, ord, n, name); role is target or competitor, ord orders the brands of a
project with the target first, n orders a brand's names, its own name first. A brand is found by the first of these steps that finds it:

exact: a name as it is written, in any case, that no letter or digit touches. Runs of letters and digits make windows of as many runs as
some name has, and windows meet names on equality, so the work does not grow with the number of names.
sound: a word of three letters or more that sounds like a name in the other script.
short: the first word that matches a name of three to six characters under any of the rules for names.

Words are matched once for each project, not once for each answer: the distinct words of a project's answers meet names on keys that lose
no match, and answers meet the few words that matched. Names and matched words are stored, so Spark broadcasts them where they are small
and shuffles where they are not; answers are shuffled at most once with their texts.

Null texts and prompts are empty, null and empty names match nothing. Answers of a null project have no brands. Repeated names count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import names as N
from sightline.functions import text as T
from sightline.operators.entities import keys, name_forms
from sightline.sources.shared import written

#: A word of a text: a letter, then letters and digits.
WORD = "[a-zA-Zа-яА-ЯёЁ][a-zA-Zа-яА-ЯёЁ0-9]*"
#: Lengths of words and names that are compared by sound, and of names that are compared by all rules.
LEAST, SHORT = 3, 6


def _core(name: Column) -> Column:
    """A name in lower case from its first letter or digit to its last."""
    return F.regexp_replace(F.lower(name), rf"^[^{T.EDGE}]+|[^{T.EDGE}]+$", "")


def _pieces(text: Column) -> Column:
    """Runs of letters and digits, and what stands between them, in turn."""
    return F.regexp_extract_all(text, F.lit(f"[{T.EDGE}]+|[^{T.EDGE}]+"), F.lit(0))


def _windows(text: Column, sizes: Column) -> Column:
    """Distinct parts of a text that begin and end with whole runs, sizes runs long."""

    def cut(pieces: Column) -> Column:
        # pieces take turns, so runs are every other one, from the first or the second
        first = F.when(F.rlike(pieces[0], F.lit(f"^[{T.EDGE}]")), 1).otherwise(2)
        at = lambda k: T.bind(F.struct(first.alias("i"), (F.size(pieces) - 2 * k + 2).alias("last")), lambda x: F.when(x["i"] <= x["last"], F.sequence(x["i"], x["last"], F.lit(2))).otherwise(F.array().cast("array<int>")))
        of = lambda k: F.transform(at(k), lambda i: F.array_join(F.slice(pieces, i, 2 * k - 1), ""))
        return F.array_distinct(F.flatten(F.transform(sizes, of)))

    none = F.array().cast("array<string>")
    return T.bind(_pieces(F.lower(text)), lambda p: F.when(F.size(p) > 0, cut(p)).otherwise(none))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _same(a: str, b: str) -> Column:
    return F.expr(f"{a} = {b}")


def matched(strings: DataFrame, names: DataFrame) -> DataFrame:
    """(project, s, brand, ord, n, name, sound, same) of the strings (project, s) that match some name of their project: by sound alone, by any rule."""
    prefixed = lambda d, p: d.select(F.col("name").alias(p + "name"), *[F.col(c).alias(p + c) for c in d.columns if c != "name"])
    a = written(prefixed(name_forms(strings.select(F.col("s").alias("name"))).withColumn("keys", keys()), "a_"), "forms")
    b = written(prefixed(name_forms(names.select("name")).withColumn("keys", keys()), "b_"), "forms")
    x = strings.join(a.select(F.col("a_name").alias("s"), F.explode("a_keys").alias("key")), "s")
    y = names.select("project", "name").distinct().join(b.select(F.col("b_name").alias("name"), F.explode("b_keys").alias("key")), "name")
    pairs = x.join(y, ["project", "key"]).select("project", "s", "name").distinct()
    sides = pairs.join(a.drop("a_keys"), _same("s", "a_name")).join(b.drop("b_keys"), _same("name", "b_name"))
    sides = sides.select("project", "s", "name", N.sounds().alias("sound"), N.match().alias("same")).where("sound or same")
    return written(sides.join(names.select("project", "brand", "role", "ord", "n", "name"), ["project", "name"]), "matched")


def _in_prompt(prompt: Column, all_names: Column) -> Column:
    return F.exists(all_names, lambda n: F.contains(F.lower(F.coalesce(prompt, F.lit(""))), n))


def resolve(answers: DataFrame, names: DataFrame, near_steps: bool = True) -> DataFrame:
    """(answer_id, project, brand, role, step, aliases, at, sentence, context, mention_type, is_recommended): one row for each brand that an answer mentions.

    answers: (answer_id, project, text, prompt). A brand whose name or alias stands in the prompt is no mention. aliases: for exact, the names
    found; otherwise the words, by sound each time they occur. at is the earliest place of any of them, in code points from 0.
    The first step does not depend on the others: without near_steps its rows are the same, and words are not matched.
    """
    a = answers.select("answer_id", "project", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("prompt", F.lit("")).alias("prompt")).where("project is not null")
    a = written(a, "answers")
    n = written(names.where("name <> ''").groupBy("project", "brand", "name").agg(F.min("role").alias("role"), F.min("ord").alias("ord"), F.min("n").alias("n")).withColumn("core", _core(F.col("name"))), "names")

    sizes = n.where("core <> ''").groupBy("project").agg(F.array_sort(F.collect_set((F.size(_pieces(F.col("core"))) + 1).cast("int") / 2)).cast("array<int>").alias("sizes"))
    windows = a.join(sizes, "project").select("answer_id", "project", F.explode(_windows(F.col("text"), F.col("sizes"))).alias("core"))
    # names without a letter or digit have no window: few, if any
    bare = a.join(n.where("core = ''"), "project").where(F.contains(F.lower("text"), F.lower("name")))
    exact = windows.join(n, ["project", "core"]).unionByName(bare, allowMissingColumns=True).select("answer_id", "project", "brand", F.lit(0).alias("step"), "n", F.col("name").alias("s"))

    hits = exact
    if near_steps:
        each = a.select("answer_id", "project", F.explode(F.array_distinct(F.transform(words(F.col("text")), lambda w: F.lower(w)))).alias("s")).where(F.length("s") >= LEAST)
        found = matched(each.select("project", "s").distinct(), n.where(F.length("name") >= LEAST))
        found = found.groupBy("project", "s", "brand").agg(F.bool_or("sound").alias("sound"), F.bool_or(F.col("same") & (F.length("name") <= SHORT)).alias("short")).where("sound or short")
        hits = exact.unionByName(each.join(written(found, "words"), ["project", "s"]).select("answer_id", "project", "brand", F.explode(F.array_compact(F.array(F.when(F.col("sound"), 1), F.when(F.col("short"), 2)))).alias("step"), F.lit(0).alias("n"), "s"))

    hits = hits.groupBy("answer_id", "project", "brand").agg(*(F.array_sort(F.collect_set(F.when(F.col("step") == k, F.struct("n", "s")))).alias(f"h{k}") for k in range(3)))
    brands = n.groupBy("project", "brand").agg(F.first("role").alias("role"), F.min("ord").alias("ord"), F.collect_set(F.lower("name")).alias("all"))
    d = a.join(hits, ["answer_id", "project"]).join(brands, ["project", "brand"]).where(~_in_prompt(F.col("prompt"), F.col("all")))

    place = lambda s: (F.regexp_instr(F.col("text"), F.concat(F.lit(r"(?iu)\Q"), s, F.lit(r"\E"))) - 1).cast("long")
    own = F.filter(F.transform("h0", lambda x: F.struct(x["s"].alias("s"), T.offset(F.col("text"), x["s"]).alias("at"))), lambda x: x["at"] >= 0)
    of = lambda k: T.bind(F.transform(k, lambda x: x["s"]), lambda s: F.filter(words(F.col("text")), lambda w: F.array_contains(s, F.lower(w))))
    by_word = lambda ws: F.transform(ws, lambda w: F.struct(w.alias("s"), place(w).alias("at")))
    got = T.bind(
        own,
        lambda e: F.when(F.size(e) > 0, F.struct(F.lit("exact").alias("step"), e.alias("of")))
        .when(F.size("h1") > 0, F.struct(F.lit("sound").alias("step"), by_word(of("h1")).alias("of")))
        .when(F.size("h2") > 0, F.struct(F.lit("short").alias("step"), by_word(F.slice(of("h2"), 1, 1)).alias("of"))),
    )
    d = d.withColumn("_got", got).where("_got is not null")
    d = d.select("answer_id", "project", "brand", "role", "text", "_got.step", F.transform("_got.of", lambda x: x["s"]).alias("aliases"), F.array_min(F.transform("_got.of", lambda x: x["at"])).alias("at"))
    d = d.withColumns({"sentence": T.sentence_index(F.col("text"), F.col("at")), "context": T.context(F.col("text"), F.col("at"))}).withColumn("mention_type", T.mention_class(F.col("context")))
    return d.withColumn("is_recommended", F.col("mention_type") == "recommended").drop("text")


def match_extracted(answers: DataFrame, entities: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that were extracted from answers, given to brands: (mentions, discovered).

    entities: (answer_id, position, name). In order of position an entity goes to the target if it matches one of its names and no entity
    did before; else to the first competitor, in order, that it matches and that has none yet. A brand that the prompt holds, as
    it is or in Latin letters, takes nothing. mentions: (answer_id, brand, role, entity, at, sentence, context); at is -1 where the entity is
    not in the text. discovered: (answer_id, position, name) of entities that went to no brand and do not match the target.
    """
    a = answers.select("answer_id", "project", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("prompt", F.lit("")).alias("prompt")).where("project is not null")
    a = written(a, "answers")
    n = written(names.where("name <> ''").select("project", "brand", "role", "ord", "n", "name").distinct(), "names")
    e = written(entities.where("name <> ''").join(a.select("answer_id", "project"), "answer_id").select("answer_id", "project", "position", F.col("name").alias("s")), "entities")
    fits = matched(e.select("project", "s").distinct(), n).where("same")
    fits = fits.groupBy("project", "s").agg(F.array_sort(F.collect_set(F.struct("ord", "brand", "role"))).alias("fits"))
    of = e.join(fits, ["project", "s"], "left").select("answer_id", F.struct("position", "s", F.coalesce("fits", F.expr("cast(array() as array<struct<ord: int, brand: string, role: string>>)")).alias("fits")).alias("e"))
    of = of.groupBy("answer_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    # brands meet the distinct prompts of a project, both in Latin letters beforehand
    brands = written(n.groupBy("project", "brand").agg(F.collect_set(F.struct(F.lower("name").alias("lower"), N.latin(F.col("name")).alias("latin"))).alias("all")), "brands")
    prompts = a.where("prompt <> ''").select("project", "prompt").distinct()
    prompts = written(prompts.select("project", "prompt", F.lower("prompt").alias("lower"), N.latin(F.col("prompt")).alias("latin")), "prompts")
    held = prompts.join(brands, "project").where(F.exists("all", lambda x: F.contains("lower", x["lower"]) | F.contains("latin", x["latin"]))).groupBy("project", "prompt").agg(F.collect_set("brand").alias("held"))
    d = a.join(of, "answer_id").join(held, ["project", "prompt"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))

    # one pass over an answer's entities: what brands have taken so far, and what each entity went to
    kind = "struct<taken: array<string>, rows: array<struct<position: int, s: string, brand: string, role: string, found: boolean>>>"

    def step(state: Column, x: Column) -> Column:
        free = F.filter(x["fits"], lambda f: ~F.array_contains(state["taken"], f["brand"]) & ~F.array_contains(F.col("held"), f["brand"]))
        to = F.get(free, F.lit(0))
        known = F.exists(x["fits"], lambda f: f["role"] == "target")
        row = F.struct(x["position"].cast("int").alias("position"), x["s"].alias("s"), to["brand"].alias("brand"), to["role"].alias("role"), (to.isNull() & ~known).alias("found"))
        taken = F.when(to.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(to["brand"])))
        return F.struct(taken.alias("taken"), F.concat(state["rows"], F.array(row)).alias("rows")).cast(kind)

    start = F.struct(F.array().alias("taken"), F.array().alias("rows")).cast(kind)
    rows = d.select("answer_id", "text", F.explode(F.aggregate("entities", start, step)["rows"]).alias("r")).select("answer_id", "text", "r.*")
    at = (F.regexp_instr(F.col("text"), F.concat(F.lit(r"(?iu)\Q"), F.col("s"), F.lit(r"\E"))) - 1).cast("long")
    mentions = rows.where("brand is not null").withColumn("at", at)
    mentions = mentions.select("answer_id", "brand", "role", F.col("s").alias("entity"), "at", F.coalesce(T.sentence_index(F.col("text"), F.col("at")), F.lit(-1)).alias("sentence"), F.coalesce(T.context(F.col("text"), F.col("at")), F.lit("")).alias("context"))
    return mentions, rows.where("found").select("answer_id", "position", F.col("s").alias("name"))
