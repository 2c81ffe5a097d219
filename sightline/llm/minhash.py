"""Near-duplicate texts by the Jaccard similarity of their word shingles: MinHash bands find candidates, the sets themselves decide.

Each text has BANDS keys of ROWS minima each; texts that share a key are candidates. Texts of similarity s share none with a chance of
(1 - s^ROWS)^BANDS: 7e-5 at 0.8, 5e-10 at 0.9. A dense group would give candidates by the square of its size, so each key first links its
texts to its smallest one and to that which meets most others. Texts of keys that these verified stars leave in several groups then meet by an exact
prefix filter of their own (see _candidates), whatever keys they share; so texts that hold one common part and are not alike make no pairs.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.windows import Hasher, mix
from sightline.operators.graph import connected_components
from sightline.sources.shared import written

BANDS, ROWS, SHINGLE, SIMILARITY = 24, 5, 5, 0.8
_RNG = np.random.default_rng(11)
_A, _B = (_RNG.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: bytes, hasher: Hasher, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's n-word shingles, words as those of the fingerprints; fewer words are one shingle."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(w), np.uint8)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) + np.arange(len(w))
    start = np.concatenate([[0], end[:-1] + 1])
    n = min(n, len(w))
    out = []
    for at in range(0, len(w) - n + 1, 16384):
        a, b = start[at : len(w) - n + 1][:16384], end[at + n - 1 :][:16384]
        hasher.load(raw[a[0] : b[-1]])
        out.append(hasher.span(a - a[0], b - a[0]))
    return np.unique(np.concatenate(out))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, mix((shingles[at : at + 2048] ^ _B) * _A).min(axis=1, keepdims=True))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ low[r::ROWS, 0])
    return key.view(np.int64)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(th, set) of a (th, text) table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(5)
        for b in batches:
            sets = [shingle_set(x.as_py() or b"", hasher, shingle).view(np.int64) for x in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["th", "set"])

    return texts.mapInArrow(run, "th long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) at or above the similarity."""
    x, y = (sets.select(F.col("th").alias(k), F.col("set").alias(f"{k}s")) for k in "ab")
    both = F.size(F.array_intersect("as", "bs"))
    return pairs.join(x, "a").join(y, "b").where(both / (F.size("as") + F.size("bs") - both) >= similarity).select("a", "b")


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different groups g that can be at or above the similarity (above 0), of a (th, g, set) table; none that is, is lost.

    Sets of n and m shingles are only alike if they share s / (1 + s) (n + m) of them. In one order of all shingles, rarest first, the first that they share
    then lies so early in both that as many are left from there on. So a set offers its early shingles, each to the sizes (in bands of 4 %) of sets
    that it can still be alike with at that place: rows in proportion to the set. Shingles of one group only come first and offer nothing. Of the sets that
    meet at a shingle, those of the group with most of them are compared with the others and not among themselves."""
    each = written(nodes.select("th", "g", F.size("set").alias("n"), F.explode("set").alias("t")), "shingles")
    found = each.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("f")).where("lo <> hi").select("t", "f")
    ranked = each.join(written(found, "frequencies"), "t").groupBy("th", "g", "n").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ts"))
    ranked = ranked.select("th", "g", "n", (F.col("n") - F.size("ts")).alias("own"), F.posexplode("ts").alias("i", "x"))
    ranked = ranked.select("th", "g", "n", (F.col("n") - F.col("own") - F.col("i")).alias("rest"), F.col("x.t").alias("t"))  # rest: this shingle and all later ones
    part = similarity / (1 + similarity)
    least, most = F.ceil(F.col("n") * similarity - 1e-6), F.floor(F.col("rest") / part - F.col("n") + 1e-6)  # sizes that it can be alike with
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.04))
    ranked = ranked.where(most >= F.greatest(least, F.lit(1))).withColumn("own", band(F.col("n")))
    offers = ranked.withColumn("other", F.explode(F.sequence(band(F.greatest(least, F.lit(1))), band(most))))
    offers = written(offers.withColumn("key", F.xxhash64("t", F.least("own", "other"), F.greatest("own", "other"))).drop("t"), "offers")
    top = offers.groupBy("key", "g").count().groupBy("key").agg(F.max(F.struct("count", "g")).alias("top"), F.count("*").alias("gs"))
    offers = written(offers.join(written(top.where("gs > 1").select("key", F.col("top.g").alias("top")), "tops"), "key"), "meeting")
    few = offers.where("g <> top").select("key", "own", "th", "g", "n", "rest")
    every = offers.select("key", F.col("other").alias("own"), F.col("th").alias("c"), F.col("g").alias("h"), F.col("n").alias("m"), F.col("rest").alias("left"), "top")
    alike = F.least("rest", "left") >= (F.col("n") + F.col("m")) * part - 1e-6
    met = few.join(every, ["key", "own"]).where((F.col("g") != F.col("h")) & ((F.col("h") == F.col("top")) | (F.col("th") < F.col("c"))) & alike)
    return met.select(F.least("th", "c").alias("a"), F.greatest("th", "c").alias("b")).distinct()


def groups(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) of the texts that have others at or above the similarity, linked directly or by others.

    nodes: (th, bands), each th once; texts: (th, text), with other and repeated rows as they come."""
    keys = written(nodes.select("th", F.explode("bands").alias("key")), "keys")
    ends = keys.groupBy("key").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.count("*").alias("n")).where("lo <> hi").drop("hi")
    shared = written(keys.join(ends, "key"), "shared")
    weight = shared.groupBy("th").agg(F.sum("n").alias("w"))  # how often a text meets others: most for the one that copies were edited from
    centre = shared.join(weight, "th").groupBy("key").agg(F.max(F.struct("w", "th")).alias("c")).select("key", F.col("c.th").alias("centre"))
    shared = written(shared.join(written(centre, "centres"), "key"), "shared")
    sets = texts.join(shared.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])
    sets = written(_sets(sets.select("th", "text"), shingle), "sets")
    pair = (F.least("th", "c").alias("a"), F.greatest("th", "c").alias("b"))
    stars = written(shared.select("th", F.explode(F.array("lo", "centre")).alias("c")).where("th <> c").select(*pair).distinct(), "stars")
    first = written(_verified(stars, sets, similarity), "first")
    held = connected_components(first).withColumnRenamed("node", "th")
    held = written(shared.select("key", "th").join(held, "th", "left").select("key", "th", F.coalesce("component", "th").alias("g")), "held")
    mixed = held.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key")
    left = held.join(mixed, "key", "left_semi").select("th", "g").distinct()
    rest = _candidates(sets.join(left, "th"), similarity)
    rest = written(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    return connected_components(first.unionByName(_verified(rest, sets, similarity)))
