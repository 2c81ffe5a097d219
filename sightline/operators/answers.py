"""Bulk analysis of AI answers: one lazy plan from raw text to scores, with no Python in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import text as T


def analyze(df: DataFrame, brand: Column, text: str = "text") -> DataFrame:
    """df with flag, clean, structure, items, at, sentence, context, mention_type, rank, weight, score, label, rvs.

    Answers that are empty, censored or refusals keep their flag and have no mention.
    """

    def found(a: Column) -> Column:
        return F.when(a["flag"].isin("clean", "think_stripped"), T.offset(a["clean"], brand)).otherwise(F.lit(-1).cast("long"))

    # a projection for each step, so that a query without the later steps does not pay for them; at and structure, by which rows are often filtered, name _a but once,
    # as a filter that moves down the plan copies what it names
    c, at = F.col("clean"), F.col("at")
    d = df.withColumn("_a", T.sanitize(F.col(text)))
    d = d.select(*df.columns, "_a.*", T.bind(F.col("_a.clean"), T.structure).alias("structure"), T.bind(F.col("_a"), found).alias("at"))
    d = d.withColumn("items", T.list_items(c, F.col("structure")))
    ranked = F.array_position(F.transform("items", lambda i: F.rlike(i, T.bounded(brand))), True)
    d = d.withColumns({
        "sentence": T.sentence_index(c, at),
        "context": T.context(c, at),
        "rank": F.when(T.may_hold(c, brand), ranked).otherwise(F.lit(0).cast("long")),
    })
    d = d.withColumns({
        "mention_type": T.mention_class(F.col("context")),
        "weight": T.position_weight(F.col("structure"), F.col("rank"), at, F.length(c)),
        "score": F.when(at >= 0, T.lexicon_score(F.col("context"))),
    })
    d = d.withColumn("label", F.when(F.col("at") >= 0, T.sentiment(F.col("score"))))
    return d.withColumn("rvs", F.round(F.col("weight") * F.when(F.col("at") >= 0, T.multiplier(F.col("label"))).otherwise(0.0), 4))


def token_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column, batch: bool = False) -> Column:
    """Price of a call; prices are by million tokens, batches cost half."""
    return F.round((prompt * price_in + completion * price_out) / 1e6 * (0.5 if batch else 1.0), 6)
