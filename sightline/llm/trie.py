"""Prefix trie of conversations by SQL ROLLUP over positional columns of turn ids.

Conversations are rows of a block of columns t1, t2, ..., a turn's id each; a ROLLUP over them has one group for every prefix, and
grouping_id tells how long it is. Where several conversations share a node at the end of a block they go on in a further block of columns,
keyed by that node; one that is alone there has a chain below it, which needs no groups. A node is named by its depth and the smallest
conversation in it, so nodes of one block key the next without further numbers. A second ROLLUP, over the nodes themselves from the last
block to the first, sums subtrees; what hangs below a block's last column is carried into it.

A turn's id is its role and text in 128 bits of SHA-256, with the text's length. Grouping combines in each task before it shuffles, so a
prefix that very many conversations share is no hot key; members are joined with their nodes by a digest of the path, a join that
adaptive execution may split. Lists of members are digested in order from pieces made by a range sort, so no list is ever held whole.

Defined results: rows of a null conversation id belong to no conversation and are left out. Null roles and texts are empty. Turns sort by
turn (null first), ties by role, then by the digest of role and text; repeated rows are turns of their own. A conversation's places are
numbered in one task, which holds its ids and not its texts. Other columns are ignored. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.sources.shared import written

#: Columns of the first block; further blocks are twice as wide as the one before, up to the second number.
WIDTH, WIDEST = 8, 32
#: Bytes of a list of members that are hashed at once.
PIECE = 1 << 16
_NOTHING = hashlib.sha256(b"").hexdigest()


def positions(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn): the turns of each conversation by place, from 1. turn is struct<n, id>: code points of the text, id of role and text."""
    t = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv is not null")
    id_ = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    t = t.select("conv", "at", "role", F.struct(F.length("text").alias("n"), id_.alias("id")).alias("turn"))
    w = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "role", "turn.id")
    return t.select("conv", F.row_number().over(w).cast("long").alias("pos"), "turn")


def _path(of: list[Column]) -> Column:
    """A digest of the ids of some turns, absent ones left out; ids are equally long, so the path is told by them alone."""
    return F.unhex(F.md5(F.concat(F.lit(b""), *(F.coalesce(t, F.lit(b"")) for t in of))))


def _rollup(rows: DataFrame, names: list[str], sums: str) -> DataFrame:
    """One group for each node and each prefix of names that some row has in full: d is its length."""
    cols = ", ".join(names)
    got = rows.sparkSession.sql(f"SELECT node, {cols}, {len(names)} - bit_count(grouping_id()) AS d, {sums} FROM {{rows}} GROUP BY node, ROLLUP ({cols})", rows=rows)
    last = reduce(lambda rest, i: F.when(F.col("d") == i + 1, F.col(names[i])).otherwise(rest), range(len(names)), F.lit(None))
    return got.withColumn("last", last).where("d = 0 or last is not null")


def _block(turns: DataFrame, key: DataFrame | None, lo: int, width: int) -> DataFrame:
    """(conv, len, node, t1...): the turns after lo as columns. key: (conv, len, node) of the conversations that go on; none in the first block."""
    place = lambda i: F.max(F.when(F.col("pos") == lo + i, F.col("turn"))).alias(f"t{i}")
    if key is None:
        return turns.groupBy("conv").agg(F.max("pos").alias("len"), F.lit(0).cast("long").alias("node"), *(place(i + 1) for i in range(width)))
    part = turns.where(F.col("pos").between(lo + 1, lo + width)).join(key, "conv")
    return part.groupBy("conv").agg(F.first("len").alias("len"), F.first("node").alias("node"), *(place(i + 1) for i in range(width)))


def _members_digest(ends: DataFrame) -> DataFrame:
    """(depth, conv, ends_sha256) of members (depth, conv, member): SHA-256 of their numbers in order, comma-joined."""
    keys = ["depth", "conv", "member"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        own, first, text, size = None, None, [], 0
        for b in batches:
            for d, c, m in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (d, c) != own or size >= PIECE:
                    if text:
                        rows.append((*own, first, ",".join(text)))
                    own, first, text, size = (d, c), m, [], 0
                text.append(str(m))
                size += len(text[-1]) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(["depth", "conv", "first", "text"], r, strict=True)) for r in rows], shape)
            rows = []
        if text:
            yield pa.RecordBatch.from_pylist([{"depth": own[0], "conv": own[1], "first": first, "text": ",".join(text)}], shape)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for b in batches:
            rows = []
            for d, c, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (d, c) != own:
                    if own:
                        rows.append({"depth": own[0], "conv": own[1], "ends_sha256": state.hexdigest()})
                    own, state = (d, c), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist(rows, done)
        if own:
            yield pa.RecordBatch.from_pylist([{"depth": own[0], "conv": own[1], "ends_sha256": state.hexdigest()}], done)

    shape = pa.schema([("depth", pa.int64()), ("conv", pa.int64()), ("first", pa.int64()), ("text", pa.string())])
    done = pa.schema([("depth", pa.int64()), ("conv", pa.int64()), ("ends_sha256", pa.string())])
    got = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pieces, "depth long, conv long, first long, text string")
    return got.repartition("depth", "conv").sortWithinPartitions("depth", "conv", "first").mapInArrow(fold, "depth long, conv long, ends_sha256 string")


def trie(turns: DataFrame, width: int = WIDTH, widest: int = WIDEST) -> DataFrame:
    """Nodes of the trie of turns (conv, pos, turn), with a row of pos 0 for every conversation.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest conversation of the node
    and of its parent, the conversations in it, the children, the childless nodes below or at it, the lengths of texts that
    sharing saves below and at it, and the digest of the conversations that end at it.
    """
    blocks: list[tuple[int, list[str], DataFrame]] = []
    ends, alone = [], []
    lo, rows = 0, written(_block(turns, None, 0, width), "block")
    while True:
        names = [f"t{i + 1}" for i in range(width)]
        nodes = _rollup(rows, names, "min(conv) AS conv, count(*) AS n_convs, max(len) AS longest")
        nodes = written((nodes if lo == 0 else nodes.where("d > 0")).withColumn("path", _path([F.col(f"{t}.id") for t in names])), "nodes")
        blocks.append((lo, names, nodes))
        # every conversation with the last node it has in this block
        stop = rows.select("conv", "len", "node", F.least(F.col("len") - lo, F.lit(width)).alias("d"), _path([F.col(f"{t}.id") for t in names]).alias("path"))
        stop = written(stop.join(nodes.select("node", "d", "path", F.col("conv").alias("owner"), "n_convs"), ["node", "d", "path"]).select("conv", "len", "owner", "n_convs"), "members")
        ends.append(stop.where(F.col("len") <= lo + width).select(F.col("len").alias("depth"), F.col("owner").alias("conv"), F.col("conv").alias("member")))
        go = stop.where(F.col("len") > lo + width)
        alone.append(go.where("n_convs = 1").select("conv", "len", F.lit(lo + width).alias("after")))
        go = go.where("n_convs > 1").select("conv", "len", F.col("owner").alias("node"))
        if go.isEmpty():
            break
        lo, width = lo + width, min(2 * width, widest)
        rows = written(_block(turns, go, lo, width), "block")

    made, carry = [], None
    for lo, names, nodes in reversed(blocks):
        width = len(names)
        open_ = (F.col("d") == width) & (F.col("longest") > lo + width)
        v = nodes.select("node", *names, F.col("d").alias("at"), "conv", "n_convs", F.coalesce((F.col("n_convs") - 1) * F.col("last.n"), F.lit(0)).alias("saved"), open_.alias("open"), (F.col("longest") == lo + F.col("d")).cast("long").alias("leaf"))
        if carry is None:
            v = v.withColumns({"below": F.lit(1).cast("long"), "more": F.lit(0).cast("long"), "kids": F.lit(1).cast("long")})
        else:
            v = v.join(carry, (F.col("open") & (F.col("n_convs") > 1)) & (F.col("conv") == F.col("top")), "left").withColumns({"below": F.coalesce("below", F.lit(1)), "more": F.coalesce("more", F.lit(0)), "kids": F.coalesce("kids", F.lit(1))})
        counts = ", ".join(f"count_if(at = {i}) AS k{i}" for i in range(1, width + 1))
        sums = f"min(conv) AS conv, max(n_convs) AS n_convs, sum(leaf + if(open, below, 0)) AS n_leaves, sum(saved + if(open, more, 0)) AS saved_tokens, sum(if(open and at = {width}, kids, 0)) AS kids, {counts}"
        tree = _rollup(v, names, sums)
        children = reduce(lambda rest, i: F.when(F.col("d") == i, F.col(f"k{i + 1}")).otherwise(rest), range(width), F.col("kids"))
        up = _path([F.when(F.col("d") > i + 1, F.col(f"{t}.id")) for i, t in enumerate(names)])
        tree = tree.select("node", "d", up.alias("up"), "conv", "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens")
        tree = written(tree, "subtrees")
        carry = tree.where("d = 0").select(F.col("node").alias("top"), F.col("n_leaves").alias("below"), F.col("saved_tokens").alias("more"), F.col("n_children").alias("kids"))
        if lo:
            tree = tree.where("d > 0")
        above = nodes.select(F.col("node").alias("node_"), (F.col("d") + 1).alias("d_"), F.col("path").alias("path_"), F.col("conv").alias("above"))
        tree = tree.join(above, (F.col("node") == F.col("node_")) & (F.col("d") == F.col("d_")) & (F.col("up") == F.col("path_")), "left")
        parent = F.coalesce("above", "node") if lo else F.col("above")  # a further block's key is the node above its first column
        made.append(tree.select(F.col("conv"), (F.col("d") + lo).cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"))

    out = reduce(DataFrame.unionByName, made).join(_members_digest(reduce(DataFrame.unionByName, ends)), ["depth", "conv"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
    chain = turns.join(reduce(DataFrame.unionByName, alone), "conv").where("pos > after")
    own = chain.select(
        F.col("pos").alias("depth"), "conv", F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("pos") == F.col("len"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(_NOTHING).alias("ends_sha256"),
    )
    cols = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return out.unionByName(own).select(F.col("conv").alias("conv_id"), *cols)


def rebuilt(turns: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Conversations that begin like the one before them whose id every divides: turns (conv, pos, turn), and a row of pos 0 for each.

    Conversation c takes the first h turns of c - c % every, h = crc32(c) % (most + 1), in place of its own first h turns.
    """
    turns = written(turns, "turns")
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") <= most)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("head"))
    own = F.when(F.col("conv") % every == 0, 0).otherwise(F.crc32(F.col("conv").cast("string")) % (most + 1)).cast("int")
    convs = turns.where("pos = 1").select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), own.alias("h")).join(heads, "base", "left")
    convs = written(convs.select("conv", "h", F.when(F.col("head").isNull(), F.array()).otherwise(F.slice("head", 1, F.col("h"))).alias("head")), "heads")
    first = convs.select("conv", F.explode("head").alias("x")).select("conv", "x.pos", "x.turn")
    rest = turns.join(convs.select("conv", "h", F.size("head").alias("p")), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("p")).alias("pos"), "turn")
    marks = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"))
    return written(first.unionByName(rest).unionByName(marks), "rebuilt")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    return trie(rebuilt(positions(table(spark, sf_dir, "conversations"))))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, text, sha256(strlen(role)::VARCHAR || ':' || role || text) AS id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
s AS (SELECT c, c - c % 100 AS base, CASE WHEN c % 100 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 END AS h
  FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT s.c, s.h, s.base, count(t.c) AS p FROM s LEFT JOIN t ON t.c = s.base AND t.pos <= s.h GROUP BY ALL),
r AS (SELECT b.c, t.pos, t.id, length(t.text) AS n FROM b JOIN t ON t.c = b.base WHERE t.pos <= b.h
  UNION ALL SELECT b.c, t.pos - b.h + b.p, t.id, length(t.text) FROM b JOIN t ON t.c = b.c WHERE t.pos > b.h),
p AS (SELECT c, pos AS d, n, sha256(string_agg(id, '') OVER (PARTITION BY c ORDER BY pos)) AS k FROM r UNION ALL SELECT c, 0, 0, '' FROM s),
v AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, max(n) AS n FROM p GROUP BY d, k),
u AS (SELECT v.*, w.c AS up, w.k AS up_k FROM v LEFT JOIN p ON p.c = v.c AND p.d = v.d - 1 LEFT JOIN v w ON w.d = p.d AND w.k = p.k),
x AS (SELECT u.*, coalesce(m.n_children, 0) AS n_children FROM u LEFT JOIN (SELECT d - 1 AS d, up_k AS k, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL) m USING (d, k)),
y AS (SELECT a.d, a.k, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.n)::BIGINT AS saved FROM x JOIN p a ON a.c = x.c AND a.d <= x.d GROUP BY a.d, a.k),
e AS (SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS l FROM p WHERE d = (SELECT max(q.d) FROM p q WHERE q.c = p.c) GROUP BY d, k)
SELECT x.c AS conv_id, x.d AS depth, x.up AS parent_conv_id, x.n_convs, x.n_children, y.n_leaves, y.saved AS saved_tokens, sha256(coalesce(e.l, '')) AS ends_sha256
FROM x JOIN y USING (d, k) LEFT JOIN e USING (d, k)
"""
