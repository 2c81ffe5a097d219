"""Training-order materialisation: packed token sequences in shards of fixed stride, in a keyed random order.

Documents are tokenised, ended by END and packed into sequences of SEQ_LEN tokens within each input partition (each partition's
last sequence is padded). Sequences are numbered through, and a keyed Feistel permutation with cycle-walking sends each number to a
global slot: training order is a bijection that needs no sort key, no table and no coordination. Slots are ranges of SHARD
sequences; each shard is written as one file of equally long records in slot order, so a reader resumes at any slot by
(slot // SHARD, slot % SHARD) alone.

Defined results: null and empty texts give their END token only. Repeated rows are tokenised as often as they come. Other
columns are ignored. An empty table gives no sequence. A very long text is encoded in pieces that end where the vocabulary's pattern ends a
word, so its ids are those of the whole text. Token ids need SEQ_LEN * 2 bytes a record up to 65,536 ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.sources.shared import shared_dir, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END, SEQ_LEN, SHARD, KEY, ROUNDS = 50256, 2048, 4096, 0x5EED, 6
MAX_PARTS = 1_000_000
_PIECE = 1 << 19


def load(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:  # on every executor, as part of its image
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """A text in parts that are encoded alike alone and together: the pattern's own matches, gathered up to _PIECE characters.

    A single match longer than that (a run of letters without a space) is a part by itself, never cut.
    """
    if len(text) <= _PIECE:
        yield text
        return
    at = 0
    for m in regex.finditer(PATTERN, text):
        if m.end() - at > _PIECE and m.start() > at:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The image of each x < n under a keyed permutation of 0..n-1: a balanced Feistel network on the next even number of bits, walked on until it falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % (1 << 64)) for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> h, v & mask
        for k in keys:
            f = (b + k) * np.uint64(0xFF51AFD7ED558CCD)
            f = (f ^ (f >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            a, b = b, a ^ ((f ^ (f >> np.uint64(29))) & mask)
        return (a << h) | b

    y = once(np.asarray(x).astype(np.uint64))
    while len(out := np.flatnonzero(y >= np.uint64(n))):
        y[out] = once(y[out])
    return y.astype(np.int64)


def sequences(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN) -> DataFrame:
    """(part, at, n_tokens, n_ends, tokens): packed sequences; tokens are little-endian 16-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = load(vocabulary), TaskContext.get().partitionId(), 0
        held = np.zeros(0, np.uint16)

        def out(flat: np.ndarray, n_tokens: list[int]) -> pa.RecordBatch:
            rows = flat.reshape(-1, seq_len)
            ends = (rows == END).sum(axis=1) - (seq_len - np.array(n_tokens))
            kinds = [pa.array(np.full(len(rows), part, np.int64)), pa.array(np.arange(at, at + len(rows), dtype=np.int64)), pa.array(n_tokens, pa.int32()), pa.array(ends.astype(np.int32))]
            return pa.RecordBatch.from_arrays([*kinds, pa.array([r.tobytes() for r in rows.astype("<u2")], pa.binary())], names=["part", "at", "n_tokens", "n_ends", "tokens"])

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                new = [held]
                for t in b.column(0).slice(lo, 64).to_pylist():
                    new += [np.array(encode.encode_ordinary(x), np.uint16) for x in pieces(t or "") if x]
                    new.append(np.array([END], np.uint16))
                held = np.concatenate(new)
                k = len(held) // seq_len
                if k:
                    yield out(held[: k * seq_len], [seq_len] * k)
                    at, held = at + k, held[k * seq_len :]
        if len(held):
            yield out(np.concatenate([held, np.full(seq_len - len(held), END, np.uint16)]), [len(held)])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "part long, at long, n_tokens int, n_ends int, tokens binary")


def materialise(df: DataFrame, path: str, text: str = "text", vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, shard: int = SHARD, key: int = KEY) -> None:
    """Writes path/shard=N, one file each, with (slot, n_tokens, n_ends, tokens) in slot order."""
    spark = df.sparkSession
    packed = written(sequences(df, text, vocabulary, seq_len), "packed")
    parts = packed.groupBy("part").agg(F.count("*").alias("n"))  # a row per input partition
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    if parts.count() <= MAX_PARTS:  # 16 bytes each; tokens are then shuffled once only
        parts = F.broadcast(parts)
    total = packed.count()

    @F.pandas_udf("long")
    def slot(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy(), total, key))

    shards = max(1, -(-total // shard))
    out = packed.join(parts, "part").select(slot(F.col("before") + F.col("at")).alias("slot"), "n_tokens", "n_ends", "tokens")
    out = out.withColumn("shard", F.floor(F.col("slot") / shard).cast("int"))
    out = out.repartitionById(shards, F.col("shard")) if hasattr(out, "repartitionById") else out.repartition(shards, "shard")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    if not total:
        spark.createDataFrame([], out.schema).write.mode("overwrite").parquet(path)


def read_shards(spark, path: str, start: int = 0, shard: int = SHARD) -> DataFrame:
    """Stored records from slot start on: a run resumes by reading only the shards that are left (folders before them are pruned)."""
    rows = spark.read.schema("slot long, n_tokens int, n_ends int, tokens binary, shard int").parquet(path)
    return rows.where((F.col("shard") >= start // shard) & (F.col("slot") >= start)) if start else rows


def token_table(df: DataFrame) -> DataFrame:
    """Materialises df and returns a row per stored record: slot, shard, place, n_tokens, n_docs ended, bytes, sha256."""
    path = f"{shared_dir(df.sparkSession)}/shards"
    materialise(df, path)
    return read_shards(df.sparkSession, path).select(
        "slot", "shard", (F.col("slot") % SHARD).cast("int").alias("place"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_ends").cast("long").alias("n_docs_ended"),
        F.octet_length("tokens").cast("long").alias("n_bytes"), F.sha2("tokens", 256).alias("tokens_sha256"),
    )


def op10_training_order(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    return token_table(table(spark, sf_dir, "documents"))
