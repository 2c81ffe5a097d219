"""Mixing sources to target weights by entropy balancing.

The rates nearest to 1 (in relative entropy) that give every source its target of words are exponentially tilted by document size,
rate = min(MAX_RATE, exp(lambda * size / scale)), one multiplier a source. The multipliers solve a convex dual; it is solved for all
sources at once by Newton steps, each one aggregation over the (source, size) histogram, with bisection where a step leaves the
bracket. Its sums are decimals, so reruns agree whatever order rows come in. Rates depend on source and size only, so they are rounded to whole copies per histogram bin, largest sizes first,
carrying what rounding leaves to the next bin: a source ends within about its smallest document of its target. Within a bin the
copies that do not divide evenly go to the documents that come first by a hash of their id.

Only the histogram (a row per source and size) is iterated over; documents are read for it and once more for the result. Ranks
inside a bin are taken over 1024 hash buckets, so a bin that holds a third of all rows is dealt out.

Defined results: a null text has size 0 and is kept once. A null source is a source and comes last. Repeated rows are rows like
others (ties of a hash are broken by id and are interchangeable). Without any words all targets are 0. Columns of df are
passed through; the operator's own columns replace those of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.words import n_words
from sightline.sources.shared import written

WEIGHTS, MAX_RATE, BUCKETS = (5, 2, 1), 3, 1024


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water-filling under max_rate * source_size. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights)).cast("double")
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_rate))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "source")
    every = Window.partitionBy(F.lit(1))
    s = s.withColumns({
        "total": F.sum("source_size").over(every).cast("double"),
        "capped": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_w": F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("capped")) / F.col("open_w")
    s = s.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("cap") * (1 + 1e-12), level)).over(every))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def _rate(lam: Column, size: Column, scale: Column, max_rate: float) -> Column:
    return F.least(F.lit(float(max_rate)), F.exp(F.least(lam * size / scale, F.lit(50.0))))


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its rows: decimals of twelve places are added, not doubles."""
    return F.sum(value.cast("decimal(28,12)")).cast("double")


def solve(hist: DataFrame, goal: DataFrame, max_rate: float = MAX_RATE, tolerance: float = 1e-9, rounds: int = 60) -> DataFrame:
    """(sk, scale, lam): multipliers by distributed Newton iterations over hist (sk, size, n); goal has (sk, target)."""
    stats = hist.groupBy("sk").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("all"), F.sum((F.col("n") * F.col("size")).cast("decimal(24,0)") * F.col("size")).cast("double").alias("sq"))
    inf = float("inf")
    start = stats.join(goal, "sk").select(
        "sk", F.coalesce(F.try_divide("sq", "all"), F.lit(1.0)).alias("scale"), F.col("target"),
        F.when(F.col("target") >= F.col("all") * max_rate * (1 - 1e-12), inf).otherwise(0.0).alias("lam"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"),
    )
    state = written(start, "newton")
    for _ in range(rounds):
        rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), max_rate)
        words = F.col("n") * F.col("size")
        free = F.when(rate < max_rate, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)
        step = hist.join(state, "sk").groupBy("sk", "scale", "target", "lam", "lo", "hi").agg(_exact_sum(words * rate).alias("got"), _exact_sum(free).alias("slope"))
        off = F.col("got") - F.col("target")
        done = (F.col("lam") == inf) | (F.abs(off) <= F.col("target") * tolerance) | (F.col("target") <= 0)
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(off, F.nullif(F.col("slope"), F.lit(0.0)))
        middle = F.when(hi == inf, F.abs(lo) * 2 + 1).when(lo == -inf, -F.abs(hi) * 2 - 1).otherwise((lo + hi) / 2)
        lam = F.when(done, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise(middle)
        state = written(step.select("sk", "scale", "target", lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "newton")
        if state.where("not done").isEmpty():
            break
        state = state.drop("done")
    return state.select("sk", "scale", "lam")


def _round_bins(bins: pd.DataFrame) -> pd.DataFrame:
    """Copies of each bin of one source (a row per size): sizes descending, the carry goes on to the next."""
    bins = bins.sort_values("size", ascending=False)
    out, want, got = [], 0.0, 0.0
    for size, n, rate, top in zip(bins["size"].tolist(), bins["n"].tolist(), bins["rate"].tolist(), bins["top"].tolist(), strict=True):
        if size == 0:
            out.append(n)
            continue
        want += n * size * rate
        k = int(min(max(round((want - got) / size), 0), top * n))
        got += k * size
        out.append(k)
    return bins.assign(copies=out)[["sk", "size", "n", "copies"]]


def mix(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, weights: tuple = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """df with size, source_size, target, copies and taken (copies * size). size: a column that already has the words."""
    key = F.when(F.col(source).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(source)))
    counted = n_words(F.col(text)) if size is None else F.col(size)
    hist = written(df.select(F.col(source).alias("source"), key.alias("sk"), counted.alias("size")).groupBy("source", "sk", "size").agg(F.count("*").alias("n")), "histogram")
    goal = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = written(targets(goal, weights, max_rate).withColumn("sk", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source")))).drop("source"), "targets")
    solved = solve(hist, goal.select("sk", "target"), max_rate)
    bins = hist.join(solved, "sk").select("sk", "size", "n", _rate(F.col("lam"), F.greatest("size", F.lit(1)), F.col("scale"), max_rate).alias("rate"), F.lit(max_rate).alias("top"))
    bins = bins.groupBy("sk").applyInPandas(_round_bins, "sk string, size long, n long, copies long").join(goal, "sk")
    own = ["size", "source_size", "target", "copies", "taken"]
    row = F.struct(*[F.col(c) for c in df.columns if c not in own]).alias("_row")
    d = df.select(row, counted.alias("size"), key.alias("_sk"), F.xxhash64(F.col(doc).cast("string")).alias("_h"), F.col(doc).alias("_doc")).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    # documents of a bin that come in earlier buckets
    buckets = d.groupBy("_sk", "size", "_b").agg(F.count("*").alias("nb"))
    before = F.sum("nb").over(Window.partitionBy("_sk", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.withColumn("before", F.coalesce(before, F.lit(0))).withColumnsRenamed({"_sk": "sk", "size": "bin", "_b": "b"})
    buckets = buckets.join(bins.withColumnRenamed("size", "bin"), ["sk", "bin"])
    at = F.row_number().over(Window.partitionBy("_sk", "size", "_b").orderBy("_h", "_doc"))
    d = d.withColumn("_at", at).join(buckets, (F.col("_sk") == F.col("sk")) & (F.col("size") == F.col("bin")) & (F.col("_b") == F.col("b")))
    more = F.when(F.col("before") + F.col("_at") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    d = d.withColumn("copies", (F.floor(F.col("copies") / F.col("n")) + more).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return d.select("_row.*", *own)


def mixed_rows(df: DataFrame, **names) -> DataFrame:
    """df's columns alone, each row as often as the mix takes it."""
    columns = df.columns
    out = mix(df.select(F.struct(*map(F.col, columns)).alias("_row"), *[F.col(c).alias(a) for a, c in (("doc_id", names.get("doc", "doc_id")), ("text", names.get("text", "text")), ("source", names.get("source", "source")))]))
    out = out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("_row.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(slim, size="size").select("doc_id", "size", "source_size", "target", "taken", "copies")
