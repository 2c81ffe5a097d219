import hashlib
import random
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import merkle as M


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(hexes):
    return M._words(b"".join(bytes.fromhex(h) for h in hexes))


def hexes(w):
    return [b.hex() for b in M._bytes(w)]


def test_states_are_those_of_sha256():
    digests = [sha(str(i)) for i in range(60)]
    state = M.fresh(60)
    for k in range(10):
        assert hexes(M.finish(state, np.full(60, k))) == [sha(d * k) for d in digests]
        state = M.absorb(state, M.block_of(words(digests)))


def tree(nodes):
    """Levels of nodes, from the leaves to the single one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute(groups):
    """{(group, place): (subroot, root, proof, folded)} for {group: [(leaf, new)]}."""
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([a for a, _ in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = {}
    for g in names:
        for at, (_, new) in enumerate(groups[g]):
            proof = ""
            for levels, i in ((trees[g], at), (top, names.index(g))):
                for nodes in levels[:-1]:
                    run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
                    proof += "".join(run[: i % 8] + run[i % 8 + 1 :])
                    new = sha("".join(run[: i % 8] + [new] + run[i % 8 + 1 :]))
                    i //= 8
            out[g, at] = trees[g][-1][0], top[-1][0], sha(proof), new
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8}, {"a": 9, None: 1, "": 2, "é": 65}, {f"g{i}": i % 11 + 1 for i in range(70)}, {"x": 5003, "y": 4097, "z": 4096, "w": 3}])
def test_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(M, "CHUNK", 100)
    groups = {g: [(sha(f"{g}:{i}"), sha(f"{g}:{i}" + "!" * (i % 3 == 0))) for i in range(n)] for g, n in sizes.items()}
    rows = [(g, i, a, b) for g, of in groups.items() for i, (a, b) in enumerate(of)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, changed string").repartition(7)
    got = M.manifest(df, replacement="changed").collect()
    assert {(r["lang"], r["doc_id"]): (r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in got} == brute(groups) and len(got) == len(rows)
    assert all((r["folded_root"] == r["root"]) == (r["leaf"] == r["changed"]) for r in got)


def test_nulls_ties_clashes(spark):
    rows = [("e", None, sha("1")), ("e", None, sha("0")), ("e", 3, sha("2")), ("e", 3, sha("2")), ("e", 3, None), (None, 1, sha("5"))]
    df = spark.createDataFrame([(*r, 9, 8, "x") for r in rows], "lang string, doc_id long, leaf string, at int, `root` int, `a.b` string")
    got = M.manifest(df).collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"lang", "doc_id", "leaf", "at", "a.b", "subroot", "root", "proof_sha256", "folded_root"}
    leaves = sorted((sha("0"), sha("1"))) + ["0" * 64] + [sha("2")] * 2
    want = brute({None: [(sha("5"), sha("5"))], "e": [(x, x) for x in leaves]})
    for r in got:
        mine = [v for (g, i), v in want.items() if g == r["lang"] and (g is None or leaves[i] == (r["leaf"] or "0" * 64))]
        assert (r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) in mine
    assert M.manifest(df.where("false")).collect() == []


def test_equal_rows_are_spread(spark):
    df = spark.range(3000).select(F.lit("e").alias("lang"), F.lit(1).cast("long").alias("doc_id"), F.lit(sha("x")).alias("leaf"))
    assert {(r["root"], r["folded_root"]) for r in M.manifest(df).collect()} == {(tree([sha("x")] * 3000)[-1][0],) * 2}


def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(M.OP12_SQL)
    names = [d[0] for d in want.description]
    got = M.op12_merkle_manifest(spark, sf_dir)
    assert got.columns == names
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want.fetchall())
    groups, low = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d["doc_id"]):
        def leaf(text):
            return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))
        changed = d["text"] and crc32(str(d["doc_id"]).encode()) % 3 == 0
        groups.setdefault(d["lang"], []).append((leaf(d["text"]), leaf(d["text"].translate(low) if changed else d["text"])))
    assert sorted(r[2:6] for r in rows) == sorted(brute(groups).values())
    assert {r[6] for r in rows} == {True, False}
