"""Vectors: exact neighbours by pivots, search in blocks, and average linkage by rounds of reciprocal nearest clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.graph import connected_components
from sightline.sources.shared import written

#: Pivots at least and at most (a vector each on the driver), and rows of either side that are compared at once.
PIVOTS, MOST_PIVOTS, ROWS = 8, 2048, 8192
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
#: Clusters of 64 dimensions that one task links by itself (fewer of more dimensions); larger components are linked by rounds.
LOCAL = 16384
#: Numbers of either side that one task of a round compares, rows that are worth a block of their own, and rows of a block that are one matrix product.
VALUES, LEAST, LEFT, RIGHT = 1 << 22, 1024, 512, 2048
#: Shares of the cut at which components are looked for; narrower ones set groups of near copies apart from what surrounds them.
STEPS = (0.125, 0.5, 1.0)


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(r, np.float64) for r in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _lists(column: pa.Array) -> np.ndarray:
    return _unit(column.to_pylist()) if len(column) else np.zeros((0, 1))


def neighbours(df: DataFrame, id_col: str, vec_col: str, distance: float) -> DataFrame:
    """(a, b, distance) of all pairs a < b within a cosine distance, exactly; zero and null vectors have no neighbours.

    Some vectors, two for every ROWS (a sample, the smallest by a hash of the id), are pivots; each vector lies with its nearest one.
    By the triangle inequality on angles, neighbours of a vector lie with pivots whose radius reaches it; of two vectors, the one with the later pivot probes the
    other's. What lies with a pivot, and what probes it, are counted first and dealt over as many blocks of ROWS rows as that takes; each pair of blocks
    is one matrix product in one task. Python gives the numbers of the pivots only, Spark makes the copies, in the type that the vectors came in.
    """
    kind = "array<float>" if df.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where("id is not null and v is not null")
    v = v.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    v = written(v.withColumn("at", F.monotonically_increasing_id()), "vectors")
    sample = v.orderBy(F.xxhash64("id"), "id", "at").limit(min(MOST_PIVOTS, max(PIVOTS, 2 * (v.count() // ROWS)))).collect()
    if not sample:
        return v.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")).where("false")
    pivots = _unit([r["v"] for r in sample])
    theta = math.acos(max(-1.0, min(1.0, 1.0 - distance))) + 1e-9

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (x.slice(lo, 1024) for x in batches for lo in range(0, x.num_rows, 1024))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            angle = np.arccos(np.clip(_lists(b.column(1)) @ pivots.T, -1, 1))
            p = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.int32)), pa.array(angle[np.arange(len(p)), p])], names=["id", "v", "at", "p", "angle"])

    homes = written(v.select("id", "v", "at").mapInArrow(home, f"id long, v {kind}, at long, p int, angle double"), "homes")
    held = {r["p"]: r for r in homes.groupBy("p").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()}  # a row for each pivot
    keys = np.array(sorted(held))
    radius = np.array([held[k]["r"] for k in keys])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            near = np.arccos(np.clip(_lists(b.column(1)) @ pivots[keys].T, -1, 1)) <= radius + theta
            near &= keys <= b.column(3).to_numpy()[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)), pa.array(keys[np.nonzero(near)[1]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["id", "v", "at", "home", "ps"])

    reached = homes.select("id", "v", "at", F.col("p").alias("home")).mapInArrow(probe, f"id long, v {kind}, at long, home int, ps array<int>")
    reached = written(reached, "reached").select("id", "v", "at", "home", F.explode("ps").alias("p"))
    counts = {r["p"]: r["count"] for r in reached.groupBy("p").count().collect()}
    blocks = homes.sparkSession.createDataFrame([(int(k), -(-counts.get(k, 0) // ROWS), -(-held[k]["n"] // ROWS)) for k in keys], "p int, xs int, ys int")
    blocks = F.broadcast(blocks)  # MOST_PIVOTS rows at most
    own = lambda n: F.pmod(F.xxhash64("at"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = reached.join(blocks, "p").select("id", "v", "home", "p", own("xs").alias("x"), every("ys").alias("y"))
    members = homes.join(blocks, "p").where("xs > 0").select("id", "v", "p", own("ys").alias("y"), every("xs").alias("x"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            y, ids = _unit(right["v"]), right["id"].to_numpy()
            for at in range(0, len(left), 256):
                part = left.iloc[at : at + 256]
                d = 1.0 - _unit(part["v"]) @ y.T
                i, j = np.nonzero(d <= distance)
                a, b = part["id"].to_numpy()[i], ids[j]
                keep = np.where(part["home"].to_numpy()[i] == part["p"].to_numpy()[i], a < b, a != b)  # vectors of one pivot probe each other, both ways
                a, b = a[keep], b[keep]
                out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": d[i, j][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": []})

    both = probes.groupBy("p", "x", "y").cogroup(members.groupBy("p", "x", "y")).applyInPandas(compare, "a long, b long, distance double")
    return both.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def search(queries: DataFrame, df: DataFrame, id_col: str, vec_col: str, distance: float) -> DataFrame:
    """(q, id, distance) of all other vectors within a cosine distance of each query, exactly; zero and null vectors are near nothing.

    Queries are dealt over blocks of about QUERY_BLOCK rows and vectors over blocks of about VECTOR_BLOCK, in turn and not by content; each pair of blocks
    is one matrix product in one task, so a task holds at most that many rows of both and their distances."""

    def dealt(t: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
        v = t.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
        v = written(v.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))), name)
        n = max(1, -(-v.count() // rows))
        at = F.monotonically_increasing_id()
        return v.withColumn("at", F.pmod(at.bitwiseAND((1 << 33) - 1) + F.shiftright(at, 33), F.lit(n)).cast("int")), n

    q, qs = dealt(queries, QUERY_BLOCK, "queries")
    v, vs = dealt(df, VECTOR_BLOCK, "vectors")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = q.withColumnRenamed("at", "x").withColumn("y", every(vs)), v.withColumnRenamed("at", "y").withColumn("x", every(qs))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i = j = np.zeros(0, np.int64)
        d = np.zeros((0, 0))
        if len(a) and len(b):
            d = 1.0 - _unit(a["v"]) @ _unit(b["v"]).T
            i, j = np.nonzero((d <= distance) & (a["id"].to_numpy()[:, None] != b["id"].to_numpy()))
        return pd.DataFrame({"q": a["id"].to_numpy()[i], "id": b["id"].to_numpy()[j], "distance": d[i, j]})

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(compare, "q long, id long, distance double")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of two tables of mean vectors: the same number for a pair from either side, in whatever block it is."""
    return 1.0 - (x * y).sum(axis=1)


def average_linkage(ids: np.ndarray, unit: np.ndarray, cut: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Cluster label (smallest id) of each vector: the nearest two clusters merge while their mean pairwise distance is at most cut. ids ascend; of equally near
    pairs, that with the smallest ids merges first. weight: how many vectors each one (then a mean) stands for.

    The mean distance of two clusters is 1 less the product of their mean vectors, so no matrix is kept. A chain goes from a cluster to its nearest one until two are each
    other's nearest; these merge, as no other merge brings anything nearer to them. What is nearest stays so until it merges."""
    n = len(ids)
    size = np.ones(n) if weight is None else weight.astype(float)
    mean, org, into = np.array(unit, np.float64), np.arange(n), np.arange(n)
    total, alive, near, far = mean * size[:, None], np.ones(n, bool), np.full(n, -1), np.full(n, np.inf)
    slack = (mean.shape[1] + 4) * 2.0**-51

    def look(rows: np.ndarray) -> None:
        s = mean[rows] @ mean.T
        s[:, ~alive] = -np.inf
        s[np.arange(len(rows)), rows] = -np.inf
        for r, row, top in zip(rows, s, s.max(axis=1) - slack):
            c = np.flatnonzero(row >= top) if top > -np.inf else np.zeros(0, int)
            d = _apart(mean[c], mean[r])
            near[r], far[r] = (c[d.argmin()], d.min()) if len(c) else (r, np.inf)

    for lo in range(0, n, 64):
        look(np.arange(lo, min(lo + 64, n)))
    alive &= far <= cut  # what is near nothing stays alone
    chain: list[int] = []
    held = np.zeros(n, bool)
    while True:
        if not chain:
            left = np.flatnonzero(alive)
            if len(left) < 2:
                break
            if 2 * len(left) < len(alive):
                place = np.where(alive, np.cumsum(alive) - 1, -1)
                near = np.where(near[left] >= 0, place[near[left]], -1)
                mean, total, size, org, far, alive, held = mean[left], total[left], size[left], org[left], far[left], alive[left], held[left]
                left = np.arange(len(left))
            chain.append(int(left[0]))
            held[left[0]] = True
        x = chain[-1]
        if not alive[x]:
            held[chain.pop()] = False
            continue
        if near[x] < 0:
            look(np.array([x]))
        y = int(near[x])
        if not far[x] <= cut:
            alive[x] = False
            near[near == x] = -1
            continue
        if near[y] < 0:
            look(np.array([y]))
        if near[y] != x:
            if held[y]:  # only by rounding
                near[chain], held[chain], chain = -1, False, []
            else:
                chain.append(y)
                held[y] = True
            continue
        x, y = min(x, y), max(x, y)
        total[x] += total[y]
        size[x] += size[y]
        mean[x] = total[x] / size[x]
        alive[y], into[org[y]] = False, org[x]
        near[(near == x) | (near == y)] = -1
        near[x] = -1
        held[chain.pop()] = False
    for i in np.flatnonzero(into != np.arange(n)):  # ascending, and into what is before
        into[i] = into[into[i]]
    return ids[into]


def _side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and mean vectors of some clusters (id, n, s)."""
    t = t.combine_chunks()
    ids, n = t["id"].to_numpy(), t["n"].to_numpy()
    s = np.concatenate([c.flatten().to_numpy() for c in t["s"].chunks] or [np.zeros(0)]).reshape(len(ids), -1 if len(ids) else 0)
    order = ids.argsort()
    return ids[order], s[order] / n[order, None]


class _Nearest:
    """The nearest of other clusters so far, for each row of a block: picked in single precision with room for its errors, then told by distance."""

    def __init__(self, mean: np.ndarray, least: float, slack: float):
        self.mean, self.slack, self.bound = mean, slack, np.full(len(mean), least, np.float32)
        self.d, self.id = np.full(len(mean), np.inf), np.full(len(mean), -1)

    def take(self, s: np.ndarray, axis: int, lo: int, ids: np.ndarray, mean: np.ndarray) -> None:
        """Products s, whose rows (axis 0) or columns (1) are those of this block from lo on, with clusters of these ids, which ascend, and means."""
        top, bound = s.max(axis=1 - axis), self.bound[lo : lo + s.shape[axis]]
        hot = np.flatnonzero(top >= bound)
        if not len(hot):
            return
        bound[hot] = np.maximum(bound[hot], top[hot] - np.float32(self.slack))
        if 4 * len(hot) < len(bound):
            s = s[hot] if axis == 0 else s[:, hot]
        else:
            hot = np.arange(len(bound))
        of = np.expand_dims(bound[hot], 1 - axis)
        at = np.divmod(np.flatnonzero(s >= of), s.shape[1])
        r, c = at[axis], at[1 - axis]
        if len(r) > 8 * len(hot):  # too alike for single precision
            t = np.where((s >= of) if axis == 0 else (s >= of).T, self.mean[lo + hot] @ mean.T, -np.inf)
            r, c = np.divmod(np.flatnonzero((t >= t.max(axis=1, keepdims=True) - (mean.shape[1] + 4) * 2.0**-51) & (t > -np.inf)), t.shape[1])
        rows = lo + hot[r]
        d = np.concatenate([_apart(self.mean[rows[k : k + 65536]], mean[c[k : k + 65536]]) for k in range(0, len(rows), 65536)])
        order = np.lexsort((c, d, rows))
        order = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
        rows, d, at = rows[order], d[order], ids[c[order]]
        better = (d < self.d[rows]) | ((d == self.d[rows]) & (at < self.id[rows]))
        self.d[rows[better]], self.id[rows[better]] = d[better], at[better]


def _connected(low: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest node that each node reaches, where low has it so far and x and y are connected too."""
    while True:
        a, b = low[x], low[y]
        left = a != b
        if not left.any():
            return low
        x, y, a, b = x[left], y[left], a[left], b[left]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]


MET = "level int, a long, b long, d double"


def _meeting(left: pa.Table, right: pa.Table, cut: float, both: bool, steps: tuple[float, ...]) -> pa.Table:
    """What two blocks of clusters are to each other, as rows of MET: of level -1, the nearest within cut (b) of each left cluster (a), and if both, of each right
    one; of a level from 0 on, stars that connect what pairs within that step of the cut connect. Memory is that of both blocks and one product."""
    (a_ids, a), (b_ids, b) = _side(left), _side(right)
    none = pa.table({"level": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
    if not len(a) or not len(b):
        return none
    slack = (a.shape[1] + 4) * 2.0**-22
    near = [_Nearest(a, 1.0 - cut - slack, slack), _Nearest(b, 1.0 - cut - slack, slack)]
    own = np.minimum(np.searchsorted(b_ids, a_ids), len(b) - 1)
    own = np.where(b_ids[own] == a_ids, own, -1)
    nodes, node = np.unique(np.concatenate([a_ids, b_ids]), return_inverse=True)
    low = [np.arange(len(nodes)) for _ in steps]
    a32, b32, room = a.astype(np.float32), b.astype(np.float32), np.empty(LEFT * RIGHT, np.float32)
    for i in range(0, len(a), LEFT):
        for j in range(0, len(b), RIGHT):
            x, y = a32[i : i + LEFT], b32[j : j + RIGHT]
            s = np.matmul(x, y.T, out=room[: len(x) * len(y)].reshape(len(x), len(y)))
            same = np.flatnonzero((own[i : i + LEFT] >= j) & (own[i : i + LEFT] < j + RIGHT))
            s[same, own[i + same] - j] = -9.0
            near[0].take(s, 0, i, b_ids[j : j + RIGHT], b[j : j + RIGHT])
            if both:
                near[1].take(s, 1, j, a_ids[i : i + LEFT], a[i : i + LEFT])
            if steps:
                at = np.flatnonzero(s >= 1.0 - cut * max(steps) - slack)
                d = 1.0 - s.ravel()[at]
                x, y = node[i + at // s.shape[1]], node[len(a) + j + at % s.shape[1]]
                for k, step in enumerate(steps):
                    within = d <= cut * step + slack
                    low[k] = _connected(low[k], x[within], y[within])
    out = [none]
    for ids, side in ((a_ids, near[0]), (b_ids, near[1]))[: 1 + both]:
        has = side.d <= cut
        out.append(pa.table({"level": np.full(has.sum(), -1, np.int32), "a": ids[has], "b": side.id[has], "d": side.d[has]}))
    for k, l in enumerate(low):
        far = np.flatnonzero(l != np.arange(len(l)))
        out.append(pa.table({"level": np.full(len(far), k, np.int32), "a": nodes[l[far]], "b": nodes[far], "d": np.zeros(len(far))}))
    return pa.concat_tables(out)


def _all_met(active: DataFrame, n: int, dim: int, cut: float) -> DataFrame:
    """MET of n clusters (id, n, s) with one another: each pair of blocks meets once."""
    tasks = active.sparkSession.sparkContext.defaultParallelism
    k = max(-(-n * dim // VALUES), min(math.isqrt(16 * tasks), -(-n // LEAST)))
    dealt = active.withColumn("x", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    left = dealt.withColumn("y", F.explode(F.sequence("x", F.lit(k - 1))))
    right = dealt.withColumnRenamed("x", "y").withColumn("x", F.explode(F.sequence(F.lit(0), "y")))

    def meet(key: tuple[pa.Scalar, ...], x: pa.Table, y: pa.Table) -> pa.Table:
        return _meeting(x, y, cut, key[0].as_py() != key[1].as_py(), STEPS)

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(meet, MET)


def _some_met(active: DataFrame, n: int, queries: int, dim: int, cut: float) -> DataFrame:
    """MET of those clusters that are stale with all n, in blocks that carry as few copies as there are tasks for."""
    tasks = min(8 * active.sparkSession.sparkContext.defaultParallelism, -(-queries * n // (LEAST * LEAST)))
    vs = min(max(-(-n * dim // VALUES), math.isqrt(tasks * n // queries)), tasks) or 1
    qs = max(-(-queries * dim // VALUES), -(-tasks // vs))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = active.where("stale").select("id", "n", "s", own(qs).alias("x"), every(vs).alias("y"))
    right = active.select("id", "n", "s", own(vs).alias("y"), every(qs).alias("x"))
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(lambda x, y: _meeting(x, y, cut, False, ()), MET)


def _near(met: DataFrame) -> DataFrame:
    """(id, nn, d): nearest cluster of each one that has any; of equally near ones, the smallest id."""
    return met.where("level < 0").groupBy(F.col("a").alias("id")).agg(F.min(F.struct("d", "b")).alias("m")).select("id", F.col("m.b").alias("nn"), F.col("m.d").alias("d"))


def _parts(met: DataFrame, most: int) -> DataFrame:
    """(id, component, level): the widest component of at most that many clusters that each one is in, if any."""
    out = rest = None
    for level in reversed(range(len(STEPS))):
        edges = met.where(F.col("level") == level).select("a", "b")
        if rest is not None:
            edges = edges.join(rest.select(F.col("id").alias("a")), "a", "left_semi")
        c = written(connected_components(edges, "a", "b").select(F.col("node").alias("id"), "component"), "parts")
        large = F.broadcast(c.groupBy("component").count().where(F.col("count") > most).select("component"))  # one for so many clusters
        small = c.join(large, "component", "left_anti").select("id", "component", F.lit(level).alias("level"))
        out, rest = small if out is None else out.unionByName(small), written(c.join(large, "component", "left_semi"), "rest")
        if rest.isEmpty():
            break
    return written(out, "small")


def _within(clusters_: DataFrame, parts: DataFrame, cut: float) -> DataFrame:
    """(gone, into): clusters that average linkage brings together inside each part (id, component, level), up to that step of the cut. Some parts share a task."""

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("id", "ascending")])
        (component, level), out = (t[c].to_numpy() for c in ("component", "level")), [np.zeros((2, 0), np.int64)]
        ends = np.append(np.flatnonzero(np.diff(component, prepend=-1)), len(t)) if len(t) else [0]
        for lo, hi in zip(ends, ends[1:]):
            part = t.slice(lo, hi - lo)
            ids, mean = _side(part)
            label = average_linkage(ids, mean, cut * STEPS[level[lo]], part["n"].to_numpy())
            out.append(np.stack([ids, label])[:, ids != label])
        gone, into = np.concatenate(out, axis=1)
        return pa.table({"gone": gone, "into": into})

    groups = max(1, -(-parts.count() // LEAST))
    t = clusters_.select("id", "n", "s").join(parts, "id").withColumn("part", F.pmod(F.xxhash64("component"), F.lit(groups)))
    return written(t.groupBy("part").applyInArrow(link, "gone long, into long"), "merged")


def _pairs(near: DataFrame) -> DataFrame:
    """(gone, into) of clusters that are each other's nearest."""
    return near.groupBy(F.greatest("id", "nn").alias("gone"), F.least("id", "nn").alias("into")).count().where("count = 2").select("gone", "into")


def _merged(active: DataFrame, near: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters (id, n, s, stale) after merging, of those that had a nearest one, and what is still known to be nearest (id, nn, d). Stale: merged, or its nearest merged."""
    keys = merged.select(F.col("gone").alias("id"), F.col("into").alias("key")).unionByName(merged.select(F.col("into").alias("id"), F.col("into").alias("key")).distinct())
    known = near.join(keys, "id", "left").join(keys.select(F.col("id").alias("nn"), F.lit(True).alias("moved")), "nn", "left")
    known = written(known.select("id", "nn", "d", "key", (F.col("key").isNotNull() | F.col("moved").isNotNull()).alias("stale")), "known")
    add = F.aggregate(
        F.array_sort(F.collect_list(F.struct("id", "s"))), F.array().cast("array<double>"), lambda t, x: F.when(F.size(t) == 0, x["s"]).otherwise(F.zip_with(t, x["s"], lambda p, q: p + q))
    )
    moved = active.select("id", "n", "s").join(known.select("id", "key", "stale"), "id")
    grown = moved.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), add.alias("s")).select(F.col("key").alias("id"), "n", "s", F.lit(True).alias("stale"))
    return written(moved.where("key is null").select("id", "n", "s", "stale").unionByName(grown), "active"), known.where("not stale").select("id", "nn", "d")


def _linked(points: DataFrame, cut: float) -> DataFrame:
    """(gone, into): merges of average linkage over points (id, n, s), each into a smaller id.

    A round merges all pairs of clusters that are each other's nearest. A merged cluster is never nearer to a third one than the nearer of its parts was, so these merges are
    among those that nearest-first merging makes, and what was nearest to a cluster stays so until it merges: only merged clusters and those whose nearest one has merged
    look for another, by blocks of matrix products against all that are left. No pair of clusters is kept beside the nearest. What has none within cut never merges and leaves.

    When all meet all (at first, and again when rounds have become slow and half are gone), components of the pairs within cut are found too. What no pair connects never
    merges, at any cut: components of at most LOCAL clusters are finished in one task each, and in larger ones those of narrower cuts are linked up to these. Pairs are ordered by distance and then
    ids, so that the first one of all is always merged, and rounds end.
    """
    n, dim = points.agg(F.count("*"), F.max(F.size("s"))).first()
    most = int(min(LOCAL, LOCAL * math.sqrt(64 / max(dim or 1, 1))))
    active, out = points, points.select(F.col("id").alias("gone"), F.col("id").alias("into")).where("false")
    whole, near, before = True, None, n
    while n > 1:
        if n <= most:
            left = active if near is None else active.join(near.select("id"), "id", "left_semi")
            return out.unionByName(_within(left, left.select("id", F.lit(0).cast("long").alias("component"), F.lit(len(STEPS) - 1).alias("level")), cut))
        if whole:
            active = active.select("id", "n", "s") if near is None else active.select("id", "n", "s").join(near.select("id"), "id", "left_semi")
            met = written(_all_met(active, n, dim, cut), "met")
            near, parts = written(_near(met), "near"), _parts(met, most)
            merged = _within(active, parts, cut)
            out, before = out.unionByName(merged), n
            near = near.join(parts.where(F.col("level") == len(STEPS) - 1).select("id"), "id", "left_anti")
            done = merged.select(F.col("gone").alias("id")).unionByName(merged.select(F.col("into").alias("id"))).distinct()
            free = near.join(done, "id", "left_anti").join(done.select(F.col("id").alias("nn")), "nn", "left_anti")
            pairs = written(_pairs(free), "pairs")
            merged, known = merged.unionByName(pairs), near.count()
        else:
            pairs = merged = written(_pairs(near), "pairs")
            known = n
        out = out.unionByName(pairs)
        count = pairs.count()
        whole = not whole and not count  # only by rounding
        if whole:
            continue
        active, kept = _merged(active, near, merged)
        n, stale = active.agg(F.count("*"), F.count_if("stale")).first()
        if stale:
            kept = kept.unionByName(_near(_some_met(active, n, stale, dim, cut)).select("id", "nn", "d"))
        near = written(kept, "near")
        n = near.count()
        whole = 16 * count < known and 2 * n <= before
    return out


def clusters(df: DataFrame, id_col: str, vec_col: str, cut: float = 0.15) -> DataFrame:
    """(id, cluster) by average linkage at a cut; a cluster is named by its smallest id.

    Equal vectors are one point with their number, so copies make no pairs. Small components of the pairs within cut are linked in one task each, larger ones by rounds, exactly. Vectors without
    neighbours, zero and null vectors stay alone, each by itself; null ids are left out, and a repeated id is as many vectors as it has.
    """
    kind = "array<float>" if df.select(vec_col).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where("id is not null")
    good = v.where(F.col("v").isNotNull()).where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    wide = F.col("v").cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda t, x: t + x * x))  # written, as inside the transform below it would be found anew for each number
    points = good.groupBy("v").agg(F.min("id").alias("name"), F.count("*").alias("n")).withColumn("norm", norm).orderBy("name", "v")
    points = written(points.withColumn("id", F.monotonically_increasing_id()), "distinct")  # in the order of names, of which some may be the same
    sums = F.transform(wide, lambda x: x / F.col("norm") * F.col("n"))
    merges = written(_linked(written(points.select("id", "n", sums.alias("s")), "points"), cut), "merges")
    named = points.select(F.col("id").alias("component"), F.col("name").alias("cluster"))
    done = connected_components(merges, "gone", "into").join(named, "component").select(F.col("node").alias("id"), "cluster")
    done = points.join(done, "id", "left").select("v", F.coalesce("cluster", "name").alias("cluster"))
    return v.join(done, "v", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))
