"""Connected components by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.sources.shared import written

#: Edges that a task contracts at once; more are contracted block by block.
BLOCK = 1 << 19


def _forest(u: pa.ChunkedArray, v: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """Stars (node, smallest node) of the components of some edges; at most as many as the edges."""
    both = pa.chunked_array([*u.chunks, *v.chunks]).combine_chunks().dictionary_encode()
    rank = np.empty(len(both.dictionary), np.int64)
    order = pc.sort_indices(both.dictionary)
    rank[order.to_numpy()] = np.arange(len(rank))
    x, y = np.split(rank[both.indices.to_numpy()], 2)
    low = np.arange(len(rank))
    while len(x):
        a, b = low[x], low[y]
        left = a != b
        x, y, a, b = x[left], y[left], a[left], b[left]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
    names, far = both.dictionary.take(order), np.flatnonzero(low != np.arange(len(low)))
    return names.take(pa.array(far)), names.take(pa.array(low[far]))


def _contracted(edges: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """Edges (u, v) that connect what these connect, written, each block of a task's edges made stars: the work of the first rounds, without a shuffle.
    There is one task for every block of edges, however many partitions hold them. Also whether all were one block, and so are stars."""
    e = written(edges, "edges")
    n = e.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays(list(_forest(t.column(0), t.column(1))), schema=t.schema)

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= block:
                yield stars()
                held = []
        if held:
            yield stars()

    return written(e.coalesce(n // block + 1).mapInArrow(run, e.schema), "contracted"), n < block


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v), v smaller, are stars: no node has two smaller neighbours, or a smaller and a larger one. One aggregation that combines before its shuffle."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or (low > 0 and high > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """(node, component) for every node of an edge table; component is the smallest node reachable.

    Alternates large-star and small-star rounds (Kiveris et al., SoCC 2014): the number of rounds grows with the
    logarithm of the nodes, each round is two aggregations and two equi-joins, and no node's neighbours are ever gathered in one row.
    Each round's minima are written before they are joined: read from a table, the neighbours of a node that most edges meet at are
    split among tasks by adaptive execution, which a join right behind an aggregation on the same key never is.
    Before each round every block of edges is contracted in one task, so that few rounds are left.
    Edges that are stars are done, before the first round as well: both kinds of round keep what is connected and the smaller end on the right.
    Self loops and repeated edges are allowed, null ends are dropped. An empty table gives an empty table.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, done = _contracted(e, block)
    while not (done or _settled(e)):
        # large star: every larger neighbour goes to the smallest of a node's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small star: every smaller neighbour, and the node, go to the smallest of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, done = _contracted(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), block)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
