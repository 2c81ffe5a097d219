"""Prompt suites: cross joins over small dimension tables, and expansion into runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators.entities import leaders
from sightline.sources.shared import written

PERSONAS = ("buyer", "expert", "novice")
TEMPLATES = (("discovery", "Which {category} is best for a {persona}?"), ("comparison", "Compare {category} with {competitor} for a {persona}"), ("price", "How much does {category} cost?"))
COMPETITORS = ("Acme", "Globex")


def matrix(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """Persona x intent x category, and x competitor where the template names one. Dimensions are fixed lists but the categories."""
    categories = queries.where("category is not null and category <> ''").select("category").distinct()
    grid = categories.select("category", F.explode(F.array(*[F.struct(F.lit(i).alias("intent"), F.lit(t).alias("template")) for i, t in TEMPLATES])).alias("t")).select("category", "t.*")
    grid = grid.withColumn("persona", F.explode(F.array(*map(F.lit, PERSONAS))))
    names = F.when(F.col("template").contains("{competitor}"), F.array(*map(F.lit, COMPETITORS))).otherwise(F.array(F.lit("")))
    grid = grid.withColumn("competitor", F.explode(names))
    text = F.col("template")
    for c in ("category", "persona", "competitor"):
        text = F.replace(text, F.lit("{" + c + "}"), F.col(c))
    return grid.withColumn("prompt", text).withColumn("prompt_id", F.left(F.md5(F.concat_ws("|", "persona", "intent", "category", "competitor")), F.lit(12)))


def expand_runs(queries: DataFrame, runs: int) -> DataFrame:
    """One request a run, with ids that depend on the query alone."""
    d = queries.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    key = F.col("query_id").cast("string")
    return d.withColumns({
        "request_id": F.left(F.sha2(F.concat(key, F.lit("|"), F.col("run").cast("string")), 256), F.lit(16)),
        "session_id": F.left(F.md5(F.concat(F.lit("session|"), key)), F.lit(12)),
    })


def tag_links(queries: DataFrame) -> DataFrame:
    """Links of queries to tags by name and type, with the number of links a tag has."""
    kinds = F.array(F.struct(F.lit("class").alias("type"), F.col("query_class").alias("tag")), F.struct(F.lit("subtype").alias("type"), F.col("subtype").alias("tag")))
    links = queries.select("query_id", F.explode(kinds).alias("k")).select("query_id", "k.type", "k.tag").where("tag is not null").distinct()
    return links.groupBy("type", "tag").agg(F.count("*").alias("links"))


#: Words that a prompt may swap, openings that make it conversational, and what each assistant is told; fixed, small dimensions of this library.
PIVOTS = (("best", "most reliable"), ("best", "cheapest"), ("cost", "take to set up"))
OPENINGS = ("Hi, ", "Quick question: ", "I am new to this. ")
ASSISTANTS = (("chat", "You are a helpful assistant."), ("search", "Answer with sources."), ("brief", "Answer in one sentence."))


def pivots(prompts: DataFrame) -> DataFrame:
    """One row per swap whose word a prompt holds, inside other words too: the first occurrence is replaced; swaps that change nothing give no row."""
    swaps = F.array(*[F.struct(F.lit(a).alias("word"), F.lit(b).alias("swap")) for a, b in PIVOTS])
    d = prompts.select("prompt_id", "prompt", F.explode(F.filter(swaps, lambda s: F.contains(F.lower("prompt"), F.lower(s["word"])))).alias("s"))
    first = F.regexp_replace("prompt", F.concat(F.lit(r"(?is)^(.*?)\Q"), F.col("s.word"), F.lit(r"\E")), F.concat(F.lit("$1"), F.col("s.swap")))
    return d.withColumn("swapped", first).where("swapped <> prompt").select("prompt_id", F.col("s.swap").alias("swap"), F.col("swapped").alias("prompt"))


def conversational(prompts: DataFrame) -> DataFrame:
    """Each prompt behind each opening, its first letter in lower case."""
    text = F.concat(F.lower(F.left("prompt", F.lit(1))), F.substr("prompt", F.lit(2)))
    return prompts.withColumn("opening", F.explode(F.array(*map(F.lit, OPENINGS)))).select("prompt_id", F.concat("opening", text).alias("prompt"))


def adapted(prompts: DataFrame) -> DataFrame:
    """One request per prompt and assistant, with its system text and an id that names both."""
    kinds = F.array(*[F.struct(F.lit(a).alias("assistant"), F.lit(t).alias("system")) for a, t in ASSISTANTS])
    d = prompts.withColumn("k", F.explode(kinds))
    return d.select(F.concat_ws(":", "prompt_id", "k.assistant").alias("request_id"), "k.assistant", "k.system", "prompt")


def near_word_sets(texts: DataFrame, id_col: str, text_col: str, similarity: float = 0.75) -> DataFrame:
    """(id, leader): greedy leaders in id order among texts whose word sets have a Jaccard similarity of at least so much.

    Candidates share one of the rarest words of each side (prefix filter, which loses no pair); texts without words stand alone.
    """
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"(?U)[^\w]+"), ""))
    t = written(texts.select(F.col(id_col).cast("string").alias("name"), F.col(id_col).alias("rank"), words.alias("words")), "words")
    each = t.select("name", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    w = Window.partitionBy("name").orderBy("often", "word")
    keep = F.col("n") - F.ceil(F.col("n") * similarity) + 1
    prefix = each.join(often, "word").withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).select("word", "name", "n")
    other = prefix.select("word", F.col("name").alias("b"), F.col("n").alias("nb"))
    near = F.least("n", "nb") >= F.greatest("n", "nb") * similarity
    cand = prefix.join(other, "word").where((F.col("name") < F.col("b")) & near).select(F.col("name").alias("a"), "b").distinct()
    side = lambda c: t.select(F.col("name").alias(c), F.col("words").alias("w" + c))
    jaccard = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    edges = cand.join(side("a"), "a").join(side("b"), "b").where(jaccard >= similarity).select("a", "b")
    return leaders(t.select("name", "rank"), edges).select(F.col("name").alias("id"), "leader")


def near_duplicates(texts: DataFrame, id_col: str, text_col: str, similarity: float = 0.75, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, leader): greedy leaders in id order among texts of one batch (the columns by) whose matching blocks make a ratio over similarity.

    The ratio is twice the characters in matching blocks (longest first, then on both sides of it, as difflib finds them) over the characters of both texts, in lower
    case and trimmed, the later text against the earlier. Over r it leaves less than 1 - r of all T characters unmatched, so there are at most as many blocks
    and one more, and the texts share more than T (1.5 r - 1) - 1 pairs of neighbouring characters. So a text is looked up by its rarest pairs only, as many as it cannot do
    without, and pairs of texts that share fewer are let go: no match is lost. Short texts, which need share none, are looked up by single characters as well.
    Equal texts are one. Null texts are empty, and empty texts equal; null ids are left out. similarity is above 2/3. Within a batch whose texts are all alike the work is that of their pairs.
    """
    import difflib

    r = similarity
    key = F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")
    t = texts.select(F.col(id_col).alias("rank"), key.alias("by"), F.trim(F.lower(F.coalesce(text_col, F.lit("")))).alias("s")).where("rank is not null")
    t = written(t, "texts")
    one = written(t.groupBy("by", "s").agg(F.min("rank").alias("rank")).withColumns({"name": F.col("rank").cast("string"), "n": F.length("s")}), "distinct")

    pieces = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.substr("s", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    nth = Window.partitionBy("name", "piece").orderBy("place")
    each = one.select("name", "by", "n", F.posexplode(pieces).alias("place", "piece")).withColumn("key", F.concat_ws(":", F.row_number().over(nth).cast("string"), "piece")).select("name", "by", "n", "key")
    each = written(each, "pieces")
    often = each.groupBy("by", "key").agg(F.count("*").alias("often"))
    w = Window.partitionBy("name").orderBy("often", "key")
    least = (1.5 * r - 1) * (1 + r / (2 - r)) * F.col("n") - 1  # of the shortest text that can match
    prefix = each.join(often, ["by", "key"]).withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("n") - 1 - F.greatest(F.ceil(least), F.lit(1)) + 1).select("name", "by", "n", "key")
    reach = 2 / (1.5 * r - 1)  # texts of no more characters together may match without a pair in common
    singles = one.where(F.col("n") <= reach * (2 - r) / 2).select("name", "by", "n", F.explode(F.array_distinct(F.split("s", ""))).alias("key"))
    keys = prefix.unionByName(singles.where("key <> ''").withColumn("key", F.concat(F.lit("1-"), "key")))
    other = keys.select("by", "key", F.col("name").alias("b"), F.col("n").alias("nb"))
    cand = keys.join(other, ["by", "key"]).where((F.col("name") < F.col("b")) & (2 * F.least("n", "nb") > r * (F.col("n") + F.col("nb")))).select(F.col("name").alias("a"), "b").distinct()

    have = each.groupBy("name").agg(F.collect_list("key").alias("keys"))
    side = lambda c: one.join(have, "name", "left").select(F.col("name").alias(c), F.col("rank").alias(f"r{c}"), F.col("s").alias(f"s{c}"), "n", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")).withColumnsRenamed({"n": f"n{c}", "keys": f"k{c}"})
    shared = F.size(F.array_intersect("ka", "kb")) > (F.col("na") + F.col("nb")) * (1.5 * r - 1) - 1
    pairs = cand.join(side("a"), "a").join(side("b"), "b").where(shared)
    later = F.col("ra") > F.col("rb")
    pairs = pairs.select("a", "b", F.when(later, F.col("sa")).otherwise(F.col("sb")).alias("new"), F.when(later, F.col("sb")).otherwise(F.col("sa")).alias("old"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for new, old in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                m = difflib.SequenceMatcher(None, new, old)
                keep.append(m.quick_ratio() > r and m.ratio() > r)
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    edges = pairs.mapInArrow(verified, "a string, b string")
    led = leaders(one.select("name", "rank"), edges)
    first = one.select("name", F.col("rank").alias("leading"))
    led = led.join(one.select("name", "by", "s"), "name").join(first.withColumnRenamed("name", "leader"), "leader").select("by", "s", "leading")
    return t.join(led, ["by", "s"]).select(F.col("rank").alias("id"), F.col("leading").alias("leader"))
