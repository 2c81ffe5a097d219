"""Entity mentions and judged answers: parsing, counting, echo of the prompt, verdicts and score texts. Expressions, joins and bounded windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import names as N
from sightline.functions import text as T
from sightline.functions.catalog import mention_key

# English phrases of the fallback classifier.
RECOMMENDING = r"\b(recommend|suggest|best choice|top pick|ideal|excellent|great option|highly rated|go.to)\b"
CRITICAL = r"\b(avoid|issues? with|problems? with|drawback|downside|not recommend|worse|inferior|lacking)\b"
COMPARING = r"\b(compar(?:e[ds]?|ing|ison)|vs\.?|versus|alternatively|instead of|better than|worse than|similar to|competitor)\b"
# Mention types and sentiment labels that a judge may give.
MENTION_TYPES = ("recommended", "compared", "negative", "direct")
LABELS = ("positive", "neutral", "negative", "mixed")
# Addresses in an answer, marks that end none, and the text of a censored one.
ADDRESS = r"https?://[^\s)\]}\"'<>,]+"
TAIL = "[.,;:!?)]+$"
CENSORED = "[CENSORED_BY_VENDOR]"


def parsed(answers: DataFrame) -> DataFrame:
    """(answer_id, position, name, context, type) of the JSON array `raw`: members are names, or objects with a name; positions count from 0.

    Other members, null and broken arrays give no row."""
    d = answers.select("answer_id", F.posexplode(F.from_json("raw", "array<string>")).alias("position", "e"))
    is_object = F.col("e").startswith("{")
    of = lambda k, default: F.when(is_object, F.coalesce(F.get_json_object("e", f"$.{k}"), F.lit(default))).otherwise(default)
    name = F.when(is_object, F.get_json_object("e", "$.name")).otherwise(F.col("e"))
    return d.select("answer_id", "position", name.alias("name"), of("context", "").alias("context"), of("type", "other").alias("type")).where("name is not null")


def by_entity(mentions: DataFrame, contexts: int = 5) -> DataFrame:
    """(key, name, type, mentions, answers, contexts): mentions of one entity, under its first spelling, with its first few contexts in alphabetical order.

    Mentions are read once: the first one of an entity in an answer stands for the answer, and what is counted by entity and context is ranked within the entity,
    so a frequent entity holds no more than these contexts."""
    m = mentions.withColumn("key", mention_key(F.col("name"))).where("key <> ''").withColumn("context", F.nullif("context", F.lit("")))
    m = m.withColumn("new", (F.row_number().over(Window.partitionBy("answer_id", "key").orderBy("position")) == 1).cast("long"))
    first = F.min(F.struct("answer_id", "position", "name", "type"))
    c = m.groupBy("key", "context").agg(first.alias("f"), F.count("*").alias("mentions"), F.sum("new").alias("answers"))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("context").asc_nulls_last())))
    few = F.array_sort(F.collect_list(F.when(F.col("n") <= contexts, F.col("context"))))
    g = c.groupBy("key").agg(F.min("f").alias("f"), F.sum("mentions").alias("mentions"), F.sum("answers").alias("answers"), few.alias("contexts"))
    return g.select("key", "f.name", "f.type", "mentions", "answers", "contexts")


def echoed(prompt: Column, names: list[Column]) -> Column:
    """Whether a prompt holds one of the names as it is or in the other script."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    held = lambda n: F.coalesce((n != "") & (F.contains(p, F.lower(n)) | F.contains(p, N.latin(n)) | F.contains(p, N.cyrillic(n))), F.lit(False))
    return reduce(lambda a, b: a | b, [held(n) for n in names], F.lit(False))


def fallback(df: DataFrame, brand: Column, competitors: list[str], text: str = "text", prompt: str = "prompt") -> DataFrame:
    """df with brand_mentioned, mention_context, mention_type and named (competitors): English phrases around a brand's first mention.

    A name that the prompt holds is no mention. Type: negative, then compared if a competitor is near, then recommended, else direct; none without a mention."""
    word = lambda n: F.concat(F.lit(r"(?i)\b\Q"), n, F.lit(r"\E\b"))
    body = F.coalesce(text, F.lit(""))
    found = ~echoed(F.col(prompt), [brand]) & (brand != "")
    d = df.withColumn("_at", F.when(found, F.regexp_instr(body, word(brand)) - 1).otherwise(-1))
    at, end = F.col("_at"), F.col("_at") + F.length(brand)

    def around(reach: int) -> Column:
        start = F.greatest(at - reach, F.lit(0))
        return F.substr(body, start + 1, end + reach - start)

    d = d.withColumns({"brand_mentioned": F.coalesce(at >= 0, F.lit(False)), "_near": F.when(at >= 0, around(150)), "mention_context": F.when(at >= 0, F.trim(around(75)))})
    near = F.col("_near")
    rival = reduce(lambda a, b: a | b, [F.rlike(near, word(F.lit(c))) for c in competitors], F.lit(False))
    kind = F.when(near.isNull(), "none").when(near.rlike("(?i)" + CRITICAL), "negative").when(rival & near.rlike("(?i)" + COMPARING), "compared").when(near.rlike("(?i)" + RECOMMENDING), "recommended").otherwise("direct")
    named = F.array_compact(F.array(*[F.when(~echoed(F.col(prompt), [F.lit(c)]) & F.rlike(body, word(F.lit(c))), c) for c in competitors]))
    return d.withColumns({"mention_type": kind, "named": named}).drop("_at", "_near")


def judged(df: DataFrame, verdict: str = "judge") -> DataFrame:
    """df whose mention_type, score and label are a judge's where its JSON can be read, with is_recommended, is_hallucination and by_judge.

    The JSON may stand in a fence. Unknown types keep the answer's own, scores are held in -1..1, unknown labels follow the score, a recommendation decides
    the type. What is no JSON object, or has a score that is no number, leaves the answer as it was."""
    fenced = F.regexp_extract(verdict, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    j = F.coalesce(F.nullif(fenced, F.lit("")), F.col(verdict))
    d = df.withColumn("_j", j)
    get = lambda k: F.get_json_object("_j", f"$.{k}")
    raw = get("sentiment_score")
    ok = F.json_object_keys("_j").isNotNull() & (raw.isNull() | raw.try_cast("double").isNotNull())
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(raw.try_cast("double"), F.lit(0.0))))
    said = F.lower(F.trim(get("mention_type")))
    flag = lambda k: F.coalesce(get(k).isin("true", "1"), F.lit(False))
    d = d.withColumns({"by_judge": F.coalesce(ok, F.lit(False)), "_s": score, "is_recommended": ok & flag("is_recommended"), "is_hallucination": ok & flag("is_hallucination")})
    label = F.coalesce(get("sentiment_label"), F.lit("neutral"))
    kind = F.when(F.col("is_recommended"), "recommended").when(said.isin(*MENTION_TYPES), said).otherwise(F.col("mention_type"))
    by = F.col("by_judge")
    d = d.withColumns({
        "mention_type": F.when(by, kind).otherwise(F.col("mention_type")),
        "label": F.when(by, F.when(label.isin(*LABELS), label).otherwise(T.sentiment(F.col("_s")))).otherwise(F.col("label")),
        "score": F.when(by, F.col("_s")).otherwise(F.col("score")),
        "is_recommended": F.coalesce("is_recommended", F.lit(False)),
        "is_hallucination": F.coalesce("is_hallucination", F.lit(False)),
    })
    return d.drop("_j", "_s")


def normal_responses(df: DataFrame) -> DataFrame:
    """Responses of vendors in one form: totals filled, addresses taken from the text of a success that names none and cleaned, one text for all that is censored.

    Columns status, text, input_tokens, output_tokens, total_tokens, cited_urls (array, may be null)."""
    text = F.coalesce("text", F.lit(""))
    parts = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    own = F.coalesce("cited_urls", F.array().cast("array<string>"))
    urls = F.when((F.col("status") == "success") & (F.size(own) == 0), F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0))).otherwise(own)
    clean = F.array_distinct(F.filter(F.transform(urls, lambda u: F.regexp_replace(F.trim(u), TAIL, "")), lambda u: u != ""))
    return df.withColumns({
        "total_tokens": F.when(F.coalesce("total_tokens", F.lit(0)) == 0, parts).otherwise(F.col("total_tokens")),
        "cited_urls": clean,
        "text": F.when((F.col("status") == "censored") & ~text.startswith(CENSORED), CENSORED).otherwise(text),
    })


def score_texts(df: DataFrame) -> DataFrame:
    """df (as analyze() makes it) with position_source, sentiment_source and rvs_formula: how the score of each answer came about."""
    s = lambda c: F.col(c).cast("string")
    listed = F.col("structure").isin("numbered_list", "table", "mixed")
    place = (
        F.when(F.col("at") < 0, "not mentioned → 0.0")
        .when(listed & (F.col("rank") > 0), F.concat("structure", F.lit(": rank #"), s("rank"), F.lit(" → 1.0 - ("), s("rank"), F.lit("-1)×0.1 = "), s("weight")))
        .when((listed | (F.col("structure") == "bulleted_list")) & (F.col("rank") <= 0), F.concat("structure", F.lit(": brand not found in list items → default 0.3")))
        .when(F.col("structure") == "bulleted_list", F.concat(F.lit("bulleted_list: uniform weight → "), s("weight")))
        .otherwise(F.concat(F.lit("narrative: char_offset="), s("at"), F.lit(" → proximity weight "), s("weight")))
    )
    factor = T.multiplier(F.col("label")).cast("string")
    formula = F.when(F.col("at") < 0, "RVS = 0.0 (brand not mentioned)").otherwise(F.concat(F.lit("RVS = 1.0 × "), s("weight"), F.lit(" × "), factor, F.lit(" = "), s("rvs")))
    feeling = F.coalesce("label", F.lit("neutral"))
    return df.withColumns({"position_source": place, "sentiment_source": F.concat(feeling, F.lit(" → "), T.multiplier(feeling).cast("string")), "rvs_formula": formula})


def traced(df: DataFrame, templates: list[tuple[str, str]], text: str = "prompt") -> DataFrame:
    """df with intent, template, match: the first template (intent, text with {slots}) that a prompt fits whole, else the one with the largest share of its
    long words in the prompt if that is above 0.4 (the first of equals), else none. The list of templates is short and fixed."""
    import re

    def pattern(t: str) -> str:
        return "(?is)^" + ".+?".join(re.escape(p) for p in re.split(r"\{[^}]+\}", t)) + "$"

    def words(t: str) -> list[str]:
        return [w.lower().strip(",.!?:") for w in re.sub(r"\{[^}]+\}", "", t).split() if len(w) > 3]

    low = F.lower(text)
    share = lambda t: sum((F.contains(low, F.lit(w)).cast("int") for w in words(t)), F.lit(0)) / max(1, len(words(t)))
    exact = F.coalesce(*[F.when(F.col(text).rlike(pattern(t)), F.struct(F.lit(i).alias("intent"), F.lit(t).alias("template"), F.lit("exact").alias("match"))) for i, t in templates])
    best = F.array_max(F.array(*[F.struct(share(t).alias("score"), F.lit(-k).alias("k"), F.lit(i).alias("intent"), F.lit(t).alias("template"), F.lit("fuzzy").alias("match")) for k, (i, t) in enumerate(templates)]))
    d = df.withColumns({"_e": exact, "_f": best})
    none = F.struct(F.lit(None).cast("string").alias("intent"), F.lit("").alias("template"), F.lit("none").alias("match"))
    fuzzy = F.struct(F.col("_f.intent").alias("intent"), F.col("_f.template").alias("template"), F.col("_f.match").alias("match"))
    return d.withColumn("_t", F.coalesce("_e", F.when(F.col("_f.score") > 0.4, fuzzy), none)).select(*df.columns, "_t.*")


def confirmed(pairs: DataFrame, verdict: str = "verdict", least: float = 0.8) -> DataFrame:
    """Pairs that an outside verdict (JSON, with text around it or not) calls the same with enough confidence; broken verdicts confirm nothing."""
    j = F.coalesce(F.nullif(F.regexp_extract(verdict, r"(?s)\{.*?\}", 0), F.lit("")), F.col(verdict))
    v = F.from_json(j, "same_entity boolean, confidence double")
    return pairs.where(v["same_entity"] & (v["confidence"] >= least))


def borderline(df: DataFrame, cluster: str, vec: str, low: float = 0.12, high: float = 0.18, most: int = 20) -> DataFrame:
    """(a, b, distance): pairs of clusters whose mean vectors lie between two cosine distances, the nearest few, to be confirmed from outside.

    cluster is a whole number. Means are sums by place, so a large cluster combines before the shuffle; vectors of a cluster have one length."""
    from sightline.operators.vectors import neighbours
    from sightline.sources.shared import written

    x = df.select(F.col(cluster).alias("c"), F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x")).where("c is not null")
    m = x.groupBy("c", "i").agg(F.avg("x").alias("x")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    d = neighbours(written(m, "means"), "c", "v", high).where(F.col("distance") >= low)
    return d.orderBy("distance", "a", "b").limit(most)
