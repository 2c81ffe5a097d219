import hashlib

import numpy as np

from sightline.llm import tokens as T


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(T.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert T.feistel(np.arange(1000), 1000, 1).tolist() != T.feistel(np.arange(1000), 1000, 2).tolist()


def test_round_trip(spark, tmp_path):
    texts = [None, "", "Hello wörld\nline two", "a " * 3000, "It's <|endoftext|> 42!", "x" * 2000] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    path = f"file://{tmp_path}/s"
    T.materialise(df, path, seq_len=64, shard=16)
    rows = T.read_shards(spark, path).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 16 and len(r["tokens"]) == 128 for r in rows)
    for k in {r["shard"] for r in rows}:
        files = spark.read.parquet(f"{path}/shard={k}").inputFiles()
        assert len(files) == 1
        slots = [r["slot"] for r in spark.read.parquet(files[0]).collect()]
        assert slots == sorted(slots)
    assert sum(r["n_ends"] for r in rows) == len(texts)
    packed = T.sequences(df, seq_len=64).orderBy("part", "at").collect()
    enc, got = T.load(), []
    for part in sorted({r["part"] for r in packed}):
        ids = np.concatenate([np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]] for r in packed if r["part"] == part]).tolist()
        while ids:
            k = ids.index(T.END)
            got.append(enc.decode(ids[:k]))
            ids = ids[k + 1 :]
    assert sorted(got) == sorted(t or "" for t in texts)
    assert sorted(bytes(r["tokens"]) for r in packed) == sorted(bytes(r["tokens"]) for r in rows)


def test_pieces_have_the_ids_of_the_whole(monkeypatch):
    enc = T.load()
    monkeypatch.setattr(T, "_PIECE", 100)
    for text in ("Some words, and\nlines of\n\n text  here " * 50, "длинноеслово" * 60 + " и другие слова\n" * 40, "é" * 950, " " * 700 + "x", "\n \n  a" * 200, "12345 it's" * 90):
        assert "".join(T.pieces(text)) == text
        assert [i for p in T.pieces(text) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def brute_feistel(k, n, key=T.KEY):
    """One number at a time, as the docstring has it: rounds on two halves, walked until below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    wrap, mask = (1 << 64) - 1, (1 << half) - 1
    while True:
        a, b = k >> half, k & mask
        for r in range(T.ROUNDS):
            f = (b + (key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93)) * 0xFF51AFD7ED558CCD & wrap
            f = (f ^ f >> 33) * 0xC4CEB9FE1A85EC53 & wrap
            a, b = b, a ^ (f ^ f >> 29) & mask
        k = a << half | b
        if k < n:
            return k


def test_query_over_table(spark, sf_dir):
    """Every sequence of the table lands in the slot that the permutation gives its number, with its own tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = [bytes(r["tokens"]) for r in T.sequences(docs).orderBy("part", "at").collect()]
    want = {brute_feistel(k, len(packed)): hashlib.sha256(t).hexdigest() for k, t in enumerate(packed)}
    got = T.op10_training_order(spark, sf_dir).collect()
    assert {r["slot"]: r["tokens_sha256"] for r in got} == want and len(got) == len(packed) > 1
    assert all(r["shard"] == r["slot"] // T.SHARD and r["place"] == r["slot"] % T.SHARD and r["n_bytes"] == 2 * T.SEQ_LEN for r in got)
    enc = T.load()
    texts = [r["text"] or "" for r in docs.collect()]
    assert sum(r["n_tokens"] for r in got) == sum(len(enc.encode_ordinary(t)) + 1 for t in texts) and sum(r["n_docs_ended"] for r in got) == len(texts)


def test_resumed_reads_and_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * 40, 1, 2) for i in range(60)] * 2, "doc_id long, text string, slot int, part int")
    path = f"file://{tmp_path}/s"
    T.materialise(df, path, seq_len=32, shard=8)
    whole = sorted((r["slot"], bytes(r["tokens"])) for r in T.read_shards(spark, path).collect())
    for start in (1, 8, 21, len(whole) - 1):
        assert sorted((r["slot"], bytes(r["tokens"])) for r in T.read_shards(spark, path, start, 8).collect()) == whole[start:]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_table(df).collect() == []
