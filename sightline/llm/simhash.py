"""SimHash near-duplicates: fingerprints, and their links by the generalised pigeonhole principle.

Links are found exactly, for all fingerprints, by the method of Qin et al. (ICDE 2018): correlated bits are grouped into
PARTS partitions; each fingerprint gets its own thresholds, one per partition, that sum to MAX_BITS - PARTS + 1 and that a
dynamic program chooses so that the estimated candidates are fewest; the fingerprint probes every partition value within its
threshold, and candidates are verified by their full distance.

A dense group of copies would give links by the square of its size. So each bucket first links its members to a few
centres of the bucket (linear work); the probing join then only lets pairs through that these stars have not connected.

Defined results: a null text or one without words has fingerprint zero, which links like any other. Documents with the same
doc_id are one node. A null doc_id is never a component's id; rows whose fingerprint occurs under null ids alone get a null component.
Repeated rows get equal results. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import minhash
from sightline.llm.windows import Hasher
from sightline.operators.graph import connected_components
from sightline.sources.shared import written

BITS, PARTS, MAX_BITS, SHINGLE, SEED = 64, 4, 4, 4, 42
WIDTH = BITS // PARTS


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """64 bits, each the majority of that bit over the XXH64 hashes of the text's n-word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= n:
        return xxh64_intdigest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, w), np.int64, len(w))) + np.arange(len(w))).tolist()
    starts = [0, *[e + 1 for e in ends]]
    total, k = np.zeros(BITS, np.int64), len(w) - n + 1
    for at in range(0, k, 16384):  # in blocks, so that a very long text needs no more memory than itself
        to = min(k, at + 16384)
        h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at:to], ends[at + n - 1 : to + n - 1])), np.uint64, to - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > k, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is a long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"") for x in raw), np.uint64, len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(fps: DataFrame) -> list[list[int]]:
    """PARTS lists of WIDTH bits: most correlated bits together. One 64 x 64 table of co-occurrence comes back from each task's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                m = _bits(x[at : at + 4096]).astype(np.float32)
                total += (m.T @ m).astype(np.int64)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["n"]
    n = max(1.0, fps.count())
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    while left:
        rest = sorted(left)
        start = max(rest, key=lambda b: (corr[b, rest].max(), -b))
        group = [start]
        while len(group) < WIDTH:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def part_values(x: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """PARTS rows: each fingerprint's value in each partition."""
    bits = _bits(x).astype(np.int64)
    return np.stack([bits[:, g] @ (1 << np.arange(len(g))) for g in groups])


def masks(width: int, e: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(e + 1) for c in combinations(range(width), k)]


def cost_tables(hist: np.ndarray) -> np.ndarray:
    """[part, threshold + 1, value]: candidates within the threshold of a value, plus what its probes cost; -1 costs nothing."""
    out = np.zeros((len(hist), MAX_BITS + 2, hist.shape[1]))
    v = np.arange(hist.shape[1])
    for i, h in enumerate(hist):
        near = np.zeros(hist.shape[1])
        for e in range(out.shape[1] - 1):
            ring = [sum(1 << b for b in c) for c in combinations(range(WIDTH), e)]
            if e <= 2:
                for m in ring:
                    near = near + h[v ^ m]
                out[i, e + 1] = near + 4.0 * len(masks(WIDTH, e))
            else:  # 697 probes and more: dearer than any other choice leaves
                out[i, e + 1] = near + 1e12
    return out


def thresholds(values: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """[part, fingerprint]: thresholds that sum to MAX_BITS - PARTS + 1 with the least estimated candidates (knapsack over parts)."""
    n, top = values.shape[1], cost.shape[1]
    want = MAX_BITS - PARTS + 1 + PARTS  # with -1 counted as 0
    best, pick = np.full((PARTS + 1, want + 1, n), np.inf), np.zeros((PARTS, want + 1, n), np.int8)
    best[0, 0] = 0
    for i in range(PARTS):
        for t in range(min(top - 1, want) + 1):
            c = cost[i, t, values[i]]
            for s in range(want + 1 - t):
                now = best[i, s] + c
                better = now < best[i + 1, s + t]
                best[i + 1, s + t][better] = now[better]
                pick[i, s + t][better] = t
    out, s = np.zeros((PARTS, n), np.int64), np.full(n, want)
    for i in range(PARTS - 1, -1, -1):
        out[i] = pick[i, s, np.arange(n)]
        s = s - out[i]
    return out - 1


def _keys(fps: DataFrame, groups: list[list[int]], cost: np.ndarray | None) -> DataFrame:
    """(key, fp, rep): a fingerprint's own partition values, or with cost the values that it probes. key is part * 2^WIDTH + value."""
    broad = None if cost is None else fps.sparkSession.sparkContext.broadcast(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [np.array(masks(WIDTH, e), np.int64) for e in range(3)]
        for b in batches:
            fp, rep = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            values = part_values(fp, groups)
            t = np.zeros_like(values) if broad is None else thresholds(values, broad.value)
            for i in range(PARTS):
                for e in range(3):
                    at = np.flatnonzero(t[i] == e)
                    for some in np.array_split(at, max(1, len(at) * len(near[e]) // 200_000)):
                        if len(some):
                            keys = (values[i, some][:, None] ^ near[e]).ravel() + (i << WIDTH)
                            k = len(near[e])
                            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fp[some], k)), pa.array(np.repeat(rep[some], k))], names=["key", "fp", "rep"])

    return fps.select("fp", "rep").mapInArrow(run, "key long, fp long, rep long")


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def components(docs: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of a (doc_id, fp) table."""
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    nodes = fps.where("rep is not null")
    if nodes.isEmpty():
        return fps.select("fp", F.col("rep").alias("component_id"))
    groups = bit_groups(nodes)
    index = _keys(nodes, groups, None)
    # stars: each bucket's members to its smallest and largest fingerprint and to two of a mixed order
    centres = index.groupBy("key").agg(
        F.count("*").alias("n"),
        *[
            f(F.struct(o.alias("o"), F.col("fp").alias("fp"), F.col("rep").alias("rep"))).alias(f"c{k}")
            for k, (f, o) in enumerate([(F.min, F.col("fp")), (F.max, F.col("fp")), (F.min, F.xxhash64("fp")), (F.max, F.xxhash64("fp"))])
        ],
    )
    centres = written(centres, "centres")  # also so that a bucket with very many members can be split in the join below
    counts = centres.select("key", "n").collect()  # at most PARTS * 2^WIDTH rows, whatever the corpus holds
    hist = np.zeros((PARTS, 1 << WIDTH))
    for r in counts:
        hist[r["key"] >> WIDTH, r["key"] & ((1 << WIDTH) - 1)] = r["n"]
    many = centres.where("n > 1").select("key", F.array("c0", "c1", "c2", "c3").alias("c"))
    stars = index.join(many, "key").select(
        F.col("rep").alias("a"), F.explode(F.filter("c", lambda c: (F.bit_count(c["fp"].bitwiseXOR(F.col("fp"))) <= MAX_BITS) & (c["rep"] != F.col("rep")))["rep"]).alias("b")
    )
    first = connected_components(stars.distinct())
    held = written(
        nodes.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("rep")), "contracted"
    )  # here rep is the id of the star component
    probes = _keys(held, groups, cost_tables(hist)).select("key", F.col("fp").alias("fa"), F.col("rep").alias("a"))
    there = _keys(held, groups, None).select("key", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    links = probes.join(there, "key").where((F.col("fa") < F.col("fb")) & (F.col("a") != F.col("b")) & _close("fa", "fb")).select("a", "b").distinct()
    last = connected_components(links).withColumnsRenamed({"node": "rep"})
    ids = held.join(last, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.select("fp").join(ids, "fp", "left")


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    docs = written(fingerprints(df, doc, text), "fingerprints")
    # written, so that the join has a shuffle on both sides and a fingerprint with very many documents can be split
    return docs.join(written(components(docs), "components"), "fp").select("doc_id", "fp", "component_id")


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, fp, bands) of the rows of a (doc_id, th, text) table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(5)
        for b in batches:
            raw = [x.as_py() or b"" for x in b.column(2).cast(pa.large_binary())]
            fps = np.fromiter(map(fingerprint, raw), np.uint64, len(raw))
            bands = pa.array([minhash.band_keys(minhash.shingle_set(x, hasher, shingle)) for x in raw], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), bands], names=["doc_id", "th", "fp", "bands"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, fp long, bands array<long>")


def dedup(df: DataFrame, doc: str = "doc_id", text: str = "text", similarity: float = minhash.SIMILARITY, shingle: int = minhash.SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; rows of a null id stay.

    Fingerprints group first, by the links of components(); the groups' smallest rows are then grouped by the Jaccard similarity of their shingles.
    Rows go by themselves: one id with two texts is two rows, of which each stays or goes with its own group."""
    th = F.xxhash64(F.col(text))
    docs = df.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), th.alias("th"), F.col(text).alias("text"))
    rows = written(_signatures(docs, shingle), "signatures")
    same = components(rows.select(F.col("fp").alias("doc_id"), "fp"))  # a node is a fingerprint here, whatever its ids
    least = rows.join(written(same, "components"), "fp").groupBy("component_id").agg(F.min(F.struct("doc_id", "th", "bands")).alias("r")).select("r.*")
    least = written(least, "least")
    near = minhash.groups(least.select("th", "bands"), docs.select("th", "text"), similarity, shingle)
    alike = least.select("doc_id", "th").join(written(near, "near").withColumnRenamed("node", "th"), "th", "left")
    keep = alike.groupBy(F.coalesce("component", "th").alias("g")).agg(F.min(F.struct("doc_id", "th")).alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th"))
    kept = df.join(keep, (F.col(doc).cast("long") == F.col("_id")) & (th == F.col("_th")), "left_semi")
    if not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        kept = kept.withColumn("_th", th).dropDuplicates([doc, "_th"]).drop("_th")
    return kept.unionByName(df.where(F.col(doc).isNull()))


def op8_simhash_components(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
