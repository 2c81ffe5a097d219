import hashlib
import random
from collections import defaultdict
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.llm import trie as R


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (*t[:3], sha(f"{len(t[2].encode())}:{t[2]}{t[3]}"))
    own = {c: [t[2:] for t in sorted(of, key=key)] for c, of in own.items() if c is not None}
    out = {}
    for c, of in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + of[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    return {
        (m[0], len(k)): (members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(str(c) for c in m if len(convs[c]) == len(k))))
        for k, m in members.items()
    }


def as_dict(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, `a.b` string").repartition(5)


def made(convs):
    return [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    convs = {}
    for c in rng.sample(range(1, 450), 150):
        start = convs[rng.choice(list(convs))] if convs and rng.random() < 0.7 else []
        start = start[: rng.randint(0, 7)]
        convs[c] = start + [(rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(0, 2)) for _ in range(rng.randint(0, 9))]
    rows = made({c: t for c, t in convs.items() if t})
    want = brute_trie(brute_rebuilt(rows))
    turns = R.rebuilt(R.positions(frame(spark, rows)))
    assert as_dict(R.trie(turns)) == want
    assert as_dict(R.trie(turns, 2, 4)) == want


def test_long_conversations_share_and_part(spark):
    turn = lambda i: ("user" if i % 2 else "assistant", f"turn {i}")
    base = [turn(i) for i in range(90)]
    convs = {200: base, 300: base, 400: base[:70], 500: base[:70] + [turn(1)] * 30, 600: base[:8], 700: base[:24], 800: base[:24] + [turn(5)], 900: [turn(9)] * 60, 1000: base[:25], 1100: base + [turn(0)]}
    assert as_dict(R.trie(R.rebuilt(R.positions(frame(spark, made(convs)))))) == brute_trie(convs)


def test_nulls_ties_and_turnless(spark):
    rows = [(1, 1, "a", "x"), (2, None, None, None), (2, 0, "a", "x"), (2, 0, "a", "x"), (2, 0, "b", "é😀"), (2, 0, "a", "w"), (None, 1, "a", "lost"), (3, 4, "", ""), (100, 1, "u", "first"), (101, 1, "u", "gone"), (105, 2, "u", "q")]
    rows += [(c, 1, "u", "one") for c in range(310, 330)]  # conversation 300 is absent: those with h > 0 have no turns left
    want = brute_trie(brute_rebuilt(rows))
    assert as_dict(R.trie(R.rebuilt(R.positions(frame(spark, rows))))) == want
    assert any(not t for t in brute_rebuilt(rows).values())
    assert as_dict(R.trie(R.rebuilt(R.positions(frame(spark, rows).where("false"))))) == {}


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 200)
    turns = spark.range(1, 3000).select((F.col("id") * 100).alias("conv_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("turn"), F.lit("u").alias("role"), F.lit("same").alias("text"))
    got = as_dict(R.trie(R.rebuilt(R.positions(turns))))
    members = ",".join(str(100 * i) for i in range(1, 3000))
    assert got == {(100, d): (100 if d else None, 2999, int(d < 3), 1, 2998 * 4 * (3 - max(d, 1) + 1), sha(members) if d == 3 else sha("")) for d in range(4)}


def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(R.OP13_SQL)
    names = [d[0] for d in want.description]
    df = R.op13_prefix_trie(spark, sf_dir)
    assert df.columns == names and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    got = as_dict(df)
    assert got == {(r[0], r[1]): r[2:] for r in want.fetchall()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute_trie(brute_rebuilt(rows))
