import random

import pyarrow  # noqa: F401
from xxhash import xxh64_intdigest

from sightline.llm import simhash as S


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[ \t-\r]+", w) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in ["", " \t", "One", "one two three", "A b c d", "a b c d e F g", "x " * 50 + "é É ü y z", " a b c d e"]:
        assert S.fingerprint(t.encode()) == brute_fp(t)


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    fps = {}
    for i in range(400):
        if i and rng.random() < 0.6:
            x = fps[rng.randrange(i)]
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps[i] = x
        else:
            fps[i] = rng.getrandbits(64)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in df.join(S.components(df), "fp").collect()}
    assert got == brute_components(fps)


def test_edge_rows(spark):
    df = spark.createDataFrame([(5, None, 1), (6, " ", 2), (None, "a b c d e f", 3), (7, "a b c d e f", 3), (7, "a b c d e f", 3)], "doc_id long, text string, fp int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in S.near_duplicates(df).collect())
    assert got == [(-1, 7), (5, 5), (6, 5), (7, 7), (7, 7)]
    assert S.near_duplicates(df.where("false")).collect() == []
    assert sorted((r["doc_id"] or -1) for r in S.dedup(df).collect()) == [-1, 5, 7]


def brute_kept(texts):
    """Ids left of distinct texts: 4-bit components' smallest, then components of five-word Jaccard >= 0.8 among those."""
    left = sorted({*brute_components({i: brute_fp(t) for i, t in texts.items()}).values()})
    sets = {i: {tuple((texts[i] or "").lower().split()[x : x + 5]) for x in range(max(1, len((texts[i] or "").split()) - 4))} for i in left}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if i < j and texts[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in left}


def test_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(160):
        w = [rng.choice(vocab) for _ in range(rng.randrange(60, 240))]
        if i and rng.random() < 0.6:
            w = texts[rng.randrange(i)].split()
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        texts[i] = " ".join(w)
    want = brute_kept(texts)
    assert len(want) < len({*brute_components({i: brute_fp(t) for i, t in texts.items()}).values()}) - 5  # near copies beyond four bits
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in S.dedup(df).collect()) == sorted(want)


def test_dedup_removes_rows_not_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    df = spark.createDataFrame([(3, a), (7, a), (7, b), (8, b), (9, c), (9, c)], "doc_id long, text string")
    assert sorted(map(tuple, S.dedup(df).collect())) == [(3, a), (7, b), (9, c)]


def test_unlike_texts_of_one_common_part_make_no_pairs(spark, monkeypatch):
    """Copies with one to nine edits each: most are like the original or nothing, and share band keys with all others."""
    from pyspark.sql import functions as F

    from sightline.llm import minhash as M

    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        w = list(base)
        for k, at in enumerate(rng.sample(range(5, 145), 1 + i % 9)):
            w[at] = f"e{i}x{k}"
        texts[i] = " ".join(w)
    sets = {i: M.shingle_set(t.encode(), M.Hasher(5)) for i, t in texts.items()}
    inter = lambda a, b: len(set(sets[a].tolist()) & set(sets[b].tolist()))
    alike = {(a, b) for a in texts for b in range(a) if (k := inter(a, b)) / (len(sets[a]) + len(sets[b]) - k) >= 0.8}
    low = {i: i for i in texts}
    for _ in texts:
        for a, b in alike:
            low[a] = low[b] = min(low[a], low[b])
    compared, verified = [], M._verified
    monkeypatch.setattr(M, "_verified", lambda pairs, *r: compared.append(pairs.count()) or verified(pairs, *r))
    nodes = spark.createDataFrame([(i, M.band_keys(s).tolist()) for i, s in sets.items()], "th long, bands array<long>")
    got = {r["node"]: r["component"] for r in M.groups(nodes, spark.createDataFrame(list(texts.items()), "th long, text string")).collect()}
    assert got == {i: c for i, c in low.items() if any(i in p for p in alike)} and 20 < len(got) < 300
    assert sum(compared) < 10 * len(texts)
    each = spark.createDataFrame([(i, i, s.view("int64").tolist()) for i, s in sets.items()], "th long, g long, set array<long>")
    assert {(r["b"], r["a"]) for r in M._candidates(each, 0.8).collect()} >= alike
    few = nodes.where(F.col("th") < 0)
    assert M.groups(few, spark.createDataFrame([], "th long, text string")).collect() == []
