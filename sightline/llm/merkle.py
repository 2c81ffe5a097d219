"""Merkle dataset manifest over hash midstates.

Rows are the leaves of one tree for each group, ordered by given columns; every run of 8 consecutive nodes has their SHA-256 as parent
until one node, the group's subroot, is left, and subroots make the root in the same way. Digests enter a hash as lower-case hex, so each
child is one 64-byte block of SHA-256, and the state of a parent's hash just before a child is 32 bytes that can be kept. Parents
keep these states: a leaf is replaced by resuming the state before its slot with the new digest and the siblings to its right only, level
by level. Proofs are hashed the same way, as states that grow by a block for each sibling.

Places in a group come from a range sort and the counts of its partitions, so a group of any size is spread over all tasks. A task works on
blocks of 4,096 neighbours, four levels of the tree at once; what stands above is a table of one row for each block, treated alike,
so that the tree is climbed in log_4096 rounds, and every block gets the steps of its way up as one row. No task holds more than a few
blocks, and nothing is collected.

Defined results: a null group is a group, the first one; groups are ordered by the bytes of their UTF-8. Nulls of the ordering columns
come first, ties are ordered by leaf, and repeated rows are leaves of their own. A null leaf is a leaf of zeros. Columns of any name are
kept, but those with the name of a result are replaced; texts enter leaves whole. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.sources.shared import written

ARITY, LEVELS = 8, 4
SPAN = ARITY**LEVELS
#: Rows that a task works on at once, besides the last block.
CHUNK = 1 << 13
#: Rows of partition counts that are broadcast, of 40 bytes each; more are joined.
MAX_PARTS = 1_000_000
_STEP = "array<struct<state: binary, slot: int, others: binary>>"


def _primes(n: int) -> list[int]:
    return [p for p in range(2, 400) if all(p % q for q in range(2, p))][:n]


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi - 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if mid**3 <= x else (lo, mid)
    return lo


#: The constants of SHA-256 by their rule: fractions of the square and cube roots of primes.
_FIRST = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def fresh(n: int) -> np.ndarray:
    """n states of a hash of nothing yet: 8 words of n columns."""
    return np.repeat(_FIRST[:, None], n, axis=1)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) of each."""

    def turn(x, k):
        return (x >> np.uint32(k)) | (x << np.uint32(32 - k))

    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (turn(y, 17) ^ turn(y, 19) ^ (y >> np.uint32(10))))
        p = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[i] + w[i]
        q = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        h, g, f, e, d, c, b, a = g, f, e, d + p, c, b, a, p + q
    return state + np.stack([a, b, c, d, e, f, g, h])


def block_of(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the block (16, n) of their hex."""
    raw = np.ascontiguousarray(digest.T.astype(">u4")).view(np.uint8)
    return np.ascontiguousarray(_HEX[raw].reshape(len(raw), 64).view(">u4").astype(np.uint32).T)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of hashes that took so many whole blocks each."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0], end[14], end[15] = 0x80000000, blocks >> 23, (blocks << 9) & 0xFFFFFFFF
    return absorb(state, end)


def _words(raw: bytes) -> np.ndarray:
    """Concatenated digests or states as (8, n)."""
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8).T)


def _bytes(words: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(words.T.astype(">u4")).tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


class Steps:
    """One level for some nodes: the state kept before each node's slot, the slot, and its siblings from left to right."""

    def __init__(self, state: np.ndarray, slot: np.ndarray, others: np.ndarray, n_others: np.ndarray):
        self.state, self.slot, self.others, self.n_others = state, slot, others, n_others  # (8, n), (n), (8, n, 7), (n)

    def fold(self, at: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Digests of the parents of nodes at, were these new: kept states resume with the new digest and what stands to the right."""
        state = absorb(self.state[:, at], block_of(new))
        for k in range(ARITY - 1):
            right = np.flatnonzero((k >= self.slot[at]) & (k < self.n_others[at]))
            if len(right):
                state[:, right] = absorb(state[:, right], block_of(self.others[:, at[right], k]))
        return finish(state, self.n_others[at] + 1)

    def prove(self, at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """States of proofs with these nodes' siblings added."""
        state = state.copy()
        for k in range(ARITY - 1):
            has = np.flatnonzero(k < self.n_others[at])
            if len(has):
                state[:, has] = absorb(state[:, has], block_of(self.others[:, at[has], k]))
        return state


def level(seq: np.ndarray, at: np.ndarray, digest: np.ndarray) -> tuple[Steps, np.ndarray, np.ndarray]:
    """(steps of these nodes, parent of each by number, parents' digests). Nodes come in order, in whole runs."""
    run = at // ARITY
    first = np.flatnonzero(np.r_[True, (seq[1:] != seq[:-1]) | (run[1:] != run[:-1])]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(at)])
    up = np.repeat(np.arange(len(first)), size)
    slot = np.arange(len(at)) - first[up]
    kept, others = np.empty_like(digest), np.zeros((8, len(at), ARITY - 1), np.uint32)
    state = fresh(len(first))
    for k in range(ARITY):
        has = np.flatnonzero(size > k)
        child = first[has] + k
        kept[:, child] = state[:, has]
        state[:, has] = absorb(state[:, has], block_of(digest[:, child]))
        for j in range(ARITY):  # this child is another one's sibling
            if j != k:
                to = np.flatnonzero((slot == j) & (size[up] > k))
                others[:, to, k - (k > j)] = digest[:, first[up[to]] + k]
    return Steps(kept, slot, others, size[up] - 1), up, finish(state, size)


def climb(seq: np.ndarray, at: np.ndarray, n: np.ndarray, digest: np.ndarray):
    """Up to LEVELS levels over whole blocks: for each, (steps, nodes that leaves stand under, which leaves it concerns); then the digests at
    the top of each leaf's way. A sequence ends at its single node."""
    ways, node, top = [], np.arange(len(at)), digest.copy()
    live = np.flatnonzero(n > 1)  # leaves whose sequence has nodes to join yet
    seq, at, n, digest = seq[live], at[live], n[live], digest[:, live]
    node = np.arange(len(live))
    for _ in range(LEVELS):
        if not len(live):
            break
        steps, up, parents = level(seq, at, digest)
        ways.append((steps, node, live))
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
        seq, at, n, digest, node = seq[first], at[first] // ARITY, -(-n[first] // ARITY), parents, up[node]
        top[:, live] = digest[:, node]
        left = n > 1
        moved = np.cumsum(left) - 1
        on = left[node]
        live, node = live[on], moved[node[on]]
        seq, at, n, digest = seq[left], at[left], n[left], digest[:, left]
    return ways, top


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (seq, block) in chunks of whole blocks."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            t = pa.Table.from_batches(held)
            seq, block = t["seq"].to_numpy(), t["block"].to_numpy()
            ends = np.flatnonzero((seq[1:] != seq[:-1]) | (block[1:] != block[:-1])) + 1
            if len(ends):
                yield t.slice(0, ends[-1])
                held = t.slice(ends[-1]).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return _words(b"".join(t[name].to_pylist()))


def _dealt(nodes: DataFrame, *order: str) -> DataFrame:
    """Blocks of neighbours, each whole and in order in one task; no block has more than SPAN nodes."""
    return nodes.withColumn("block", F.expr(f"at div {SPAN}")).repartition("seq", "block").sortWithinPartitions("seq", "block", *order)


def _tops(leaves: DataFrame) -> DataFrame:
    """The nodes above all blocks of leaves (seq, at, n, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            at, n = t["at"].to_numpy(), t["n"].to_numpy()
            _, top = climb(t["seq"].to_numpy(), at, n, _column(t, "digest"))
            first = np.flatnonzero(at % SPAN == 0)
            yield pa.RecordBatch.from_arrays([t["seq"].combine_chunks().take(pa.array(first)), pa.array(at[first] // SPAN), pa.array(-(-n[first] // SPAN)), pa.array(_bytes(top[:, first]), pa.binary())], names=["seq", "at", "n", "digest"])

    return _dealt(leaves.select("seq", "at", "n", "digest"), "at").mapInArrow(run, "seq long, at long, n long, digest binary")


def _paths(nodes: DataFrame) -> DataFrame:
    """(seq, at, path, peak) for nodes (seq, at, n, digest): the steps from each node to the single node of its sequence, and that node's digest."""
    done = nodes.where("n <= 1").select("seq", "at", F.expr(f"cast(array() as {_STEP})").alias("path"), F.col("digest").alias("peak"))
    if nodes.where("n > 1").isEmpty():
        return done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            ways, top = climb(t["seq"].to_numpy(), t["at"].to_numpy(), t["n"].to_numpy(), _column(t, "digest"))
            steps: list[list[dict]] = [[] for _ in range(len(t))]
            for s, node, live in ways:
                kept = _bytes(s.state)
                for leaf, x in zip(live.tolist(), node.tolist(), strict=True):
                    steps[leaf].append({"state": kept[x], "slot": int(s.slot[x]), "others": b"".join(_bytes(s.others[:, x, : s.n_others[x]]))})
            kind = pa.list_(pa.struct([("state", pa.binary()), ("slot", pa.int32()), ("others", pa.binary())]))
            yield pa.RecordBatch.from_arrays([t["seq"].combine_chunks(), t["at"].combine_chunks(), t["n"].combine_chunks(), pa.array(steps, kind), pa.array(_bytes(top), pa.binary())], names=["seq", "at", "n", "steps", "top"])

    storey = written(_dealt(nodes.where("n > 1"), "at").mapInArrow(run, f"seq long, at long, n long, steps {_STEP}, top binary"), "storey")
    above = storey.where(f"at % {SPAN} = 0").select("seq", F.expr(f"at div {SPAN}").alias("at"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("top").alias("digest"))
    above = _paths(above).withColumnRenamed("at", "block")
    ways = storey.withColumn("block", F.expr(f"at div {SPAN}")).join(above, ["seq", "block"]).select("seq", "at", F.concat("steps", "path").alias("path"), "peak")
    return written(ways.unionByName(done), "paths")


def _placed(df: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(df with mid, before, first and n, by which its rows have places in their groups; the groups with their sizes)."""
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_rid")]
    # a number of each row lets equal rows go to different ranges; it is stored before it is used
    rows = written(df.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    rows = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_part", F.shiftrightunsigned("_mid", 33))
    parts = written(rows.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_count"), F.min("_mid").alias("_first")), "parts")
    w = Window.partitionBy("_group")  # a group has a row for each partition
    parts = parts.withColumns({"_before": F.sum("_count").over(w.orderBy("_part")) - F.col("_count"), "_n": F.sum("_count").over(w)})
    sizes = parts.groupBy("_group").agg(F.max("_n").alias("_n"))
    offsets = parts.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), "_before", "_first", F.col("_n").alias("n"))
    if parts.count() <= MAX_PARTS:
        offsets = F.broadcast(offsets)
    rows = rows.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return rows.withColumn("at", F.col("_before") + F.col("_mid") - F.col("_first")), sizes


def field(value: Column) -> Column:
    """A value as a leaf takes it: bytes of its UTF-8 text, a colon, the text; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def manifest(df: DataFrame, leaf: str = "leaf", group: str = "lang", order: tuple[str, ...] = ("doc_id",), replacement: str | None = None) -> DataFrame:
    """df with subroot, root, proof_sha256 and folded_root (lower-case hex): the root after a leaf was replaced by its replacement alone.

    leaf and replacement are digests in hex. Columns are carried through three shuffles: select what is needed first.
    """
    names = [c for c in df.columns if c not in ("subroot", "root", "proof_sha256", "folded_root")]
    zeros = F.lit("0" * 64)
    row = df.select(
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("row"), F.col(f"`{group}`").cast("string").alias("group"), *(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)),
        F.unhex(F.coalesce(f"`{leaf}`", zeros)).alias("digest"), F.unhex(F.coalesce(f"`{replacement or leaf}`", zeros)).alias("new"),
    )
    rows, sizes = _placed(row, "group", [F.col(f"o{i}").asc_nulls_first() for i in range(len(order))] + [F.col("digest")])
    groups, _ = _placed(sizes.withColumn("_all", F.lit(0)).withColumnRenamed("_group", "name").drop("_n"), "_all", [F.col("name").asc_nulls_first()])
    groups = written(groups.select("name", F.col("at").alias("seq"), F.col("n").alias("n_groups")), "groups")
    numbers = groups.select("name", "seq")
    if numbers.count() <= MAX_PARTS:
        numbers = F.broadcast(numbers)
    leaves = written(rows.join(numbers, F.col("group").eqNullSafe(F.col("name"))).select("seq", "at", "n", "digest", "new", "row"), "leaves")
    blocks = written(_tops(leaves), "blocks")
    own = _paths(blocks)
    roots = own.where("at = 0").join(groups, "seq").select(F.lit(0).cast("long").alias("seq"), F.col("seq").alias("at"), F.col("n_groups").alias("n"), F.col("peak").alias("digest"))
    last = _paths(written(roots, "subroots")).select(F.col("at").alias("seq"), F.col("path").alias("last"), F.col("peak").alias("root"))
    ways = own.join(last, "seq").select("seq", (F.col("at") * SPAN).alias("at"), F.concat("path", "last").alias("path"), F.col("peak").alias("subroot"), "root")

    kind = leaves.schema["row"].dataType.simpleString()
    both = leaves.select("seq", "at", F.lit(1).alias("leaf"), "n", "digest", "new", "row", F.expr(f"cast(null as {_STEP})").alias("path"), F.expr("cast(null as binary)").alias("subroot"), F.expr("cast(null as binary)").alias("root"))
    both = both.unionByName(ways.select("seq", "at", F.lit(0).alias("leaf"), F.lit(0).cast("long").alias("n"), F.expr("cast(null as binary)").alias("digest"), F.expr("cast(null as binary)").alias("new"), F.expr(f"cast(null as {kind})").alias("row"), "path", "subroot", "root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            is_leaf = t["leaf"].to_numpy() == 1
            heads = t.filter(pa.array(~is_leaf))
            head = (np.cumsum(~is_leaf) - 1)[is_leaf]  # a block's way up stands before its leaves
            t = t.filter(pa.array(is_leaf))
            ways, _ = climb(t["seq"].to_numpy(), t["at"].to_numpy(), t["n"].to_numpy(), _column(t, "digest"))
            new, proof, blocks = _column(t, "new"), fresh(len(t)), np.zeros(len(t), np.int64)
            paths = heads["path"].to_pylist()
            for k in range(max(map(len, paths), default=0)):
                has = [i for i, p in enumerate(paths) if len(p) > k]
                steps = [paths[i][k] for i in has]
                size = np.array([len(s["others"]) // 32 for s in steps])
                others = _words(b"".join(s["others"].ljust(32 * (ARITY - 1), b"\0") for s in steps)).reshape(8, len(has), ARITY - 1)
                place = np.full(len(paths), -1)
                place[has] = np.arange(len(has))
                live = np.flatnonzero(place[head] >= 0)
                ways.append((Steps(_words(b"".join(s["state"] for s in steps)), np.array([s["slot"] for s in steps]), others, size), place[head[live]], live))
            for steps, node, live in ways:
                new[:, live] = steps.fold(node, new[:, live])
                proof[:, live] = steps.prove(node, proof[:, live])
                blocks[live] += steps.n_others[node]
            made = [heads[c].combine_chunks().take(pa.array(head)) for c in ("subroot", "root")]
            yield pa.RecordBatch.from_arrays([t["row"].combine_chunks(), *made, pa.array(_bytes(finish(proof, blocks)), pa.binary()), pa.array(_bytes(new), pa.binary())], names=["row", "subroot", "root", "proof", "folded"])

    out = _dealt(both, "leaf", "at").mapInArrow(run, f"row {kind}, subroot binary, root binary, proof binary, folded binary")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)), *(F.lower(F.hex(a)).alias(b) for a, b in (("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select("doc_id", "lang", leaf_of(*head, F.col("text")).alias("leaf"), F.when(tampered, leaf_of(*head, lower)).alias("changed"))
    out = manifest(rows.withColumn("changed", F.coalesce("changed", "leaf")), replacement="changed")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 8) -> str:
    """The trees level by level, for up to 8 ** levels leaves of a language and as many languages."""
    field_ = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(field_(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    parts = [
        f"docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, sha256({head} || {field_('text')}) AS leaf, sha256({head} || {field_(lower)}) AS low, {crc} % 3 = 0 AS changed FROM documents)",
        "a0 AS (SELECT r, doc_id, leaf, CASE WHEN changed THEN low ELSE leaf END AS f, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS seq, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM docs)",
        "f0 AS (SELECT r, seq, pos, f, '' AS proof FROM a0)", "t0 AS (SELECT seq, pos, n, leaf AS d FROM a0)",
    ]

    def climb_(nodes: str, docs: str, k: int) -> None:
        parts.append(f"r{k} AS (SELECT seq, pos // 8 AS pos, n, list(d ORDER BY pos) AS l FROM {nodes} GROUP BY seq, pos // 8, n)")
        parts.append(f"t{k} AS (SELECT seq, pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS d FROM r{k})")
        parts.append(
            f"f{k} AS (SELECT r, f.seq, f.pos // 8 AS pos, CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(l[1:f.pos % 8] || [f] || l[f.pos % 8 + 2:], '')) END AS f, "
            f"CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(l[1:f.pos % 8] || l[f.pos % 8 + 2:], '') END AS proof FROM {docs} f JOIN r{k} r ON f.seq = r.seq AND f.pos // 8 = r.pos)"
        )

    for k in range(1, levels + 1):
        climb_(f"t{k - 1}", f"f{k - 1}", k)
    k = levels + 1
    parts += [f"t{k} AS (SELECT 0 AS seq, seq AS pos, count(*) OVER () AS n, d FROM t{levels})", f"f{k} AS (SELECT r, 0 AS seq, seq AS pos, f, proof FROM f{levels})"]
    for k in range(levels + 2, 2 * levels + 2):
        climb_(f"t{k - 1}", f"f{k - 1}", k)
    return (
        f"WITH {', '.join(parts)} SELECT a.doc_id, a.leaf, s.d AS subroot, t.d AS root, sha256(f.proof) AS proof_sha256, f.f AS folded_root, f.f = t.d AS verified "
        f"FROM a0 a JOIN f{k} f USING (r) JOIN t{levels} s ON s.seq = a.seq JOIN t{k} t ON true"
    )


OP12_SQL = _sql()
