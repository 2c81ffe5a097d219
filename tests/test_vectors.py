import numpy as np
import pyarrow as pa

from sightline.operators import vectors as V


def brute_clusters(ids, m, cut):
    u = V._unit(m)
    d = 1 - u @ u.T
    parts = [[i] for i in range(len(ids))]
    while len(parts) > 1:
        best = min(((np.mean([d[a, b] for a in x for b in y]), i, j) for i, x in enumerate(parts) for j, y in enumerate(parts) if i < j))
        if best[0] > cut:
            break
        parts[best[1]] += parts.pop(best[2])
    return {ids[i]: min(ids[k] for k in p) for p in parts for i in p}


def test_neighbours_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(V, "PIVOTS", 5)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6))
    m = np.concatenate([c + rng.normal(scale=0.25, size=(7, 6)) for c in centres])
    rows = [(i, x.tolist()) for i, x in enumerate(m)]
    df = spark.createDataFrame([*rows, (900, [0.0] * 6), (901, None)], "vec_id long, e array<double>")
    u = V._unit(m)
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if 1 - u[i] @ u[j] <= 0.1}
    assert {(r["a"], r["b"]) for r in V.neighbours(df, "vec_id", "e", 0.1).collect()} == want
    got = {r["id"]: r["cluster"] for r in V.clusters(df, "vec_id", "e", 0.1).collect()}
    assert got == {**brute_clusters(list(range(len(m))), m, 0.1), 900: 900, 901: 901}
    assert V.clusters(df.where("false"), "vec_id", "e").collect() == []


def test_large_component_by_rounds(spark, monkeypatch):
    """One component of 1,200 points and copies: rounds of joins against the matrix of one task."""
    rng = np.random.default_rng(9)
    steps = np.cumsum(rng.uniform(0.02, 0.2, size=1200))  # a walk on a circle, thickened: near neighbours overlap all the way
    m = np.stack([np.cos(steps / 40), np.sin(steps / 40), *(rng.normal(scale=0.03, size=(3, 1200)))], axis=1)
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(1200) * 2, m)]
    copies = [(5001 + k, rows[k % 7][1]) for k in range(40)]
    df = spark.createDataFrame(rows + copies, "vec_id long, e array<double>").repartition(6)
    every = sorted(rows + copies)
    ids, u = np.array([i for i, _ in every]), V._unit([x for _, x in every])
    want = dict(zip(ids.tolist(), V.average_linkage(ids, u, 0.004).tolist()))
    monkeypatch.setattr(V, "LOCAL", 50)
    got = {r["id"]: r["cluster"] for r in V.clusters(df, "vec_id", "e", 0.004).collect()}
    assert got == want and 5 < len(set(want.values())) < 600


def matrix_clusters(ids, m, cut, n):
    """Nearest pair first on a whole matrix of distances, for ids that ascend; n: how many vectors each row stands for."""
    u = V._unit(m)
    d, n, part = 1 - u @ u.T, np.array(n, float), np.arange(len(ids))
    np.fill_diagonal(d, np.inf)
    while d.min() <= cut:
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        d[i] = d[:, i] = (n[i] * d[i] + n[j] * d[j]) / (n[i] + n[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        n[i] += n[j]
        part[part == j] = i
    return np.asarray(ids)[part]


def test_chains_merge_as_the_nearest_pair_would():
    rng = np.random.default_rng(12)
    for k, dim, cut, spread in ((300, 6, 0.1, 9.0), (400, 16, 0.5, 1.0), (250, 8, 0.9, 0.01), (300, 3, 0.3, 2.0)):
        m, n = np.ones(dim) + rng.normal(scale=spread, size=(k, dim)), rng.integers(1, 5, size=k)
        ids = np.sort(rng.choice(5000, k, replace=False))
        assert (V.average_linkage(ids, V._unit(m), cut, n) == matrix_clusters(ids, m, cut, n)).all()


def test_blocks_find_the_nearest_of_near_copies():
    """Distances of 1e-10, which single precision can't tell, beside plain ones; in one block and in two, from either side."""
    rng = np.random.default_rng(13)
    m = np.concatenate([rng.normal(size=(80, 5)), np.ones((120, 5)) + rng.normal(scale=1e-5, size=(120, 5))])
    u, ids = V._unit(m), rng.permutation(200)
    table = lambda at: pa.table({"id": ids[at], "n": np.full(len(at), 2), "s": (2 * u[at]).tolist()})
    d = 1 - (u[:, None] * u[None]).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for x, y, both in ((np.arange(200), np.arange(200), False), (np.arange(0, 200, 2), np.arange(1, 200, 2), True)):
        got = V._meeting(table(x), table(y), 0.4, both, (0.5, 1.0)).to_pylist()
        sides = ((x, y), (y, x))[: 1 + both]
        want = {int(ids[i]): int(ids[min(q, key=lambda j: (d[i, j], ids[j]))]) for p, q in sides for i in p if d[i, q].min() <= 0.4}
        assert {r["a"]: r["b"] for r in got if r["level"] < 0} == want and len(want) > 120
        for level, within in ((0, 0.2), (1, 0.4)):
            low, edges = {int(i): int(i) for i in ids}, [(int(ids[i]), int(ids[j])) for i in x for j in y if d[i, j] <= within]
            for _ in range(200):
                for a, b in edges:
                    low[a] = low[b] = min(low[a], low[b])
            stars = {r["b"]: r["a"] for r in got if r["level"] == level}
            assert {i: stars.get(i, i) for i in low} == low


def test_rounds_keep_no_pairs(spark, monkeypatch):
    """83,000 pairs of 800 vectors are within the cut: no table that is written has them, and clusters are the same."""
    counts, write = {}, V.written

    def counted(df, name="table", free=False):
        out = write(df, name, free)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(V, "written", counted)
    monkeypatch.setattr(V, "LOCAL", 100)
    monkeypatch.setattr(V, "LEAST", 200, raising=False)
    m = np.random.default_rng(14).normal(size=(800, 12))
    u = V._unit(m)
    assert (np.triu(1 - u @ u.T <= 0.8, 1)).sum() > 100 * 800
    got = {r["id"]: r["cluster"] for r in V.clusters(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, e array<double>"), "vec_id", "e", 0.8).collect()}
    assert got == dict(enumerate(matrix_clusters(np.arange(800), m, 0.8, np.ones(800)).tolist()))
    assert max(counts.values()) < 20 * 800


def test_one_id_of_two_vectors(spark):
    """Each vector of a repeated id is one row, in its own cluster."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, -1.0])]
    got = sorted((r["id"], r["cluster"]) for r in V.clusters(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e", 0.1).collect())
    assert got == [(1, 1), (2, 2), (3, 1), (3, 2), (3, 2), (4, 4)]


def test_blocks_follow_counts(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 16)
    monkeypatch.setattr(V, "PIVOTS", 3)
    rng = np.random.default_rng(5)
    m = np.concatenate([np.ones((60, 4)) + rng.normal(scale=0.05, size=(60, 4)), rng.normal(size=(60, 4))])  # half of all rows lie with one pivot
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(7, m[7].tolist())], "vec_id long, e array<double>")
    u = V._unit(m)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if 1 - u[i] @ u[j] <= 0.05}
    got = [(r["a"], r["b"]) for r in V.neighbours(df, "vec_id", "e", 0.05).collect()]
    assert set(got) == want and len(got) == len(want) > 1000


def test_probes_are_numbers_and_go_one_way(spark, monkeypatch):
    """Where every pivot is in reach, a vector leaves Python once, in its own type, and meets the vectors of another pivot from one side only."""
    from pyspark.sql import functions as F

    kept, write = {}, V.written
    monkeypatch.setattr(V, "written", lambda df, name="table": kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(V, "PIVOTS", 40)
    rng = np.random.default_rng(6)
    m = (np.ones((300, 4)) + rng.normal(scale=0.3, size=(300, 4))).astype(np.float32)
    rows = [*enumerate(m), (7, m[8])]  # one id twice
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, e array<float>")
    u = V._unit([x for _, x in rows])
    d = 1 - u @ u.T
    want = {(i, j) for x, (i, _) in enumerate(rows) for y, (j, _) in enumerate(rows) if i < j and d[x, y] <= 0.2}
    got = [(r["a"], r["b"]) for r in V.neighbours(df, "vec_id", "e", 0.2).collect()]
    assert set(got) == want and len(got) == len(want) > 1000
    reached = kept["reached"]
    assert reached.count() == 301 and dict(reached.dtypes)["v"] == "array<float>"
    assert reached.agg(F.sum(F.size("ps"))).first()[0] < 0.7 * 301 * 40


def test_search_meets_all_vectors(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sightline.plans import entities as E

    rng = np.random.default_rng(4)
    m = np.repeat(rng.normal(size=(40, 8)), 5, axis=0) + rng.normal(scale=0.4, size=(200, 8))
    label = [None if i % 7 == 0 else i % 3 for i in range(200)]
    df = spark.createDataFrame([(i, x.tolist(), y) for i, (x, y) in enumerate(zip(m, label))] + [(900, [0.0] * 8, 1), (950, None, 1)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(E, "table", lambda *_: df)
    u = V._unit(m)
    want = {(i, j) for i in range(0, 200, 50) for j in range(200) if i != j and round(1 - u[i] @ u[j], 6) <= 0.6}
    assert any(label[i] != label[j] for i, j in want) and any(label[j] is None for _, j in want)
    for sizes in ((512, 4096), (2, 30)):
        monkeypatch.setattr(V, "QUERY_BLOCK", sizes[0])
        monkeypatch.setattr(V, "VECTOR_BLOCK", sizes[1])
        got = [(r["q"], r["vec_id"]) for r in E.vector_search(spark, "").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert V.search(df, df.where(F.lit(False)), "vec_id", "embedding", 0.6).collect() == []
