import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from sightline.llm import bpe as B

HARD = [
    None, "", " ", "  ", "a", "a  b", "a \n b", "\n\n", " lead", "trail ", "don't we'll 'S", "日本語 テキスト", "😀😀 é\x1cx\x85y", "  z", "<|endoftext|>", "a" * 3000, "=-" * 700, "x1y22 333", "é" * 99, "The quick\tbrown\r\nfox",
]


@pytest.fixture(scope="module")
def both():
    raw, pattern = B.vocabulary_file()
    mine = B.codec(raw, pattern)
    return mine, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=mine.ranks, special_tokens={})


def ids(mine, text):
    return np.frombuffer(b"".join(mine.encode(text)), np.int32).tolist()


def test_ids_are_those_of_the_merges(both):
    mine, want = both
    rng = random.Random(5)
    letters = list("abcdeiou ting  \n\t'sZ-_=019") + ["é", "ß", "日", "😀", " ", "\x1c"]
    texts = [t for t in HARD if t] + ["".join(rng.choices(letters, k=rng.randint(1, 80))) for _ in range(3000)] + ["".join(rng.choices("abcdefgh", k=800)) for _ in range(20)]
    for t in texts:
        assert ids(mine, t) == want.encode_ordinary(t), repr(t)


def test_tokens_alone_and_in_pairs(both):
    mine, want = both
    rng = random.Random(6)
    known = [t for t in (x.decode("utf-8", "ignore") for x in mine.ranks) if t]
    for t in known[::7] + [a + b for a, b in zip(rng.choices(known, k=4000), rng.choices(known, k=4000), strict=True)]:
        assert ids(mine, t) == want.encode_ordinary(t), repr(t)


def test_stretches_and_forgotten_memos(both, monkeypatch):
    _, want = both
    monkeypatch.setattr(B, "_STRETCH", 64)
    monkeypatch.setattr(B, "MEMO", 5)
    raw, pattern = B.vocabulary_file()
    small = B.Codec(B.codec(raw, pattern).ranks, pattern)
    text = "".join(random.Random(7).choices(list("abc  \n,") + ["word ", " über"], k=4000))
    assert len(list(small.encode(text))) > 10
    assert ids(small, text) == want.encode_ordinary(text)
    assert len(small.goes_on) <= 5


def test_a_token_that_no_merge_makes():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 300, b"bcd": 257, b"cd": 258}  # bcd and abc: b + cd is never met, ab comes first
    own = B.Codec(ranks, r"\S+|\s+")
    want = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for t in ["abc", "bcd", "abcd", "xbcd", "xabc", "ababcdcd", "bcdbcd"]:
        assert ids(own, t) == want.encode_ordinary(t), t


def test_columns(spark, both):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)] * 2, "`ids` long, text string, `a.b` string")
    out = B.encode(df, "text", "tokens")
    assert out.columns == ["ids", "text", "a.b", "tokens"]
    rows = B.decode(out, "tokens", "text").orderBy("ids").collect()
    assert len(rows) == 2 * len(HARD) and rows[0].asDict().keys() == {"ids", "a.b", "tokens", "text"}
    for r in rows:
        assert r["tokens"] == both[1].encode_ordinary(HARD[r["ids"]] or "") and bytes(r["text"]) == (HARD[r["ids"]] or "").encode()
    assert B.decode(B.encode(df.where("false"))).collect() == []
    once = B.encode(df, data="text").orderBy("ids").collect()
    assert all(bytes(r["text"]) == b"".join(both[0].token[i] for i in r["ids"]) for r in once) and sorted(bytes(r["text"]) for r in once) == sorted(bytes(r["text"]) for r in rows)
    nulls = spark.createDataFrame([(None,), ([],), ([None, 64],)], "ids array<int>")
    assert [r["data"] and bytes(r["data"]) for r in B.decode(nulls).collect()] == [None, b"", b"a"]
    assert B.encode(df.withColumn("ids", F.lit(1))).schema["ids"].dataType.simpleString() == "array<int>"


def test_query(spark, sf_dir, both):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = B.op11_bpe_roundtrip(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = both[1].encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(" ".join(map(str, want)).encode()), sha(texts[r["doc_id"]].encode()))
