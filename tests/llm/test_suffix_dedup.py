import hashlib
import random
import time

import numpy as np
import pytest

from sightline.llm import suffix_dedup as D
from sightline.sources.shared import CLEANUP


def brute(rows, n=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest())
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in D.remove_repeats(df).collect()}


@pytest.mark.parametrize("hot", [4096, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(D, "HOT", hot)
    monkeypatch.setattr(D, "LOCAL_HOT", min(hot, D.LOCAL_HOT))
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdé\0") for _ in range(rng.randrange(1, 7)))
    line = " ".join(word() for _ in range(60))
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 350), (None, line), (4, "ab" * 400), (5, "é" * 200)]
    for i in range(6, 60):
        t = " ".join(word() for _ in range(rng.randrange(5, 200)))
        k = rng.random()
        if k < 0.3:
            t = t[: len(t) // 2] + line[rng.randrange(40) :] + t[len(t) // 2 :]
        elif k < 0.6 and rows[-1][1]:
            t = rows[-1][1]
            at = rng.randrange(len(t) + 1)
            t = t[:at] + word() + t[at + 3 :]
        elif k < 0.7:
            t = rng.choice(rows)[1]
        rows.append((i, t))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)


def test_long_text_and_repeated_rows(spark):
    rng = random.Random(1)
    long = " ".join(str(rng.random()) for _ in range(40_000))
    rows = [(1, long), (2, long[300_000:420_000]), (3, "q" + long)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    twice = spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")
    assert got(twice)[1][1] == 0
    assert got(twice.where("false")) == {}


def test_query_over_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in D.op3_suffix_array_dedup(spark, sf_dir).collect()}
    assert out == brute(rows)


def naive_lpf(suffixes, places):
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return [max((common(s, t) for t, q in zip(suffixes, places, strict=True) if q < p), default=0) for s, p in zip(suffixes, places, strict=True)]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd\0"])
def test_lpf_equals_naive(alphabet):
    rng = np.random.default_rng(len(alphabet))
    for n in (1, 2, 3, 17, 150):
        buf = rng.choice(np.frombuffer(alphabet, np.uint8), n + 40)
        starts, depth, place = rng.integers(0, n, n), rng.integers(1, 40, n), rng.integers(0, n, n)
        got = D.lpf(buf, starts, depth, place).tolist()
        assert got == naive_lpf([buf[s : s + d].tobytes() for s, d in zip(starts, depth, strict=True)], place.tolist())


def test_hot_line_is_spread(spark):
    """A line in every text: no minimum keeps more rows under one key than a task may hold unspread."""
    line = "the same words of a licence that every single text of this corpus has as its very first line, and"
    rows = [(i, f"{hash((i, 1)) % 10**12} {line} {hash((i, 2)) % 10**12} " + " ".join(str(hash((i, j))) for j in range(12))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.select(df.doc_id.alias("doc"), "text").coalesce(1)
    most = D._rows(docs, 100, 16).where("salt >= 0").groupBy("g", "salt").count().agg({"count": "max"}).first()[0]
    assert most < D.LOCAL_HOT
    assert got(df) == brute(rows)


def test_clashing_columns(spark):
    rows = [(1, "x" * 350, 5, 6), (2, "y" * 350, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc long, runs int")
    assert got(df) == brute([r[:2] for r in rows])


def test_shuffle_files_go_with_each_table(spark):
    """What the tables of the steps were shuffled by does not wait on disk for the driver's garbage collector."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {f for f in (every.apply(i).getName() for i in range(every.size())) if f.startswith("shuffle_") and f.endswith(".data")}

    rng = random.Random(5)
    line = " ".join(str(rng.random()) for _ in range(20))
    rows = [(i, f"{rng.random()} {line if i % 2 else rng.random()} {rng.random()}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.count()
    before = files()
    out = D.remove_repeats(df)
    for _ in range(50):  # files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(CLEANUP, None) is None
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()} == brute(rows)
