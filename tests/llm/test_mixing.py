import random
from collections import defaultdict

from sightline.llm import mixing as M


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        for s in over or open_:
            out[s] = 3.0 * sizes[s] if over else left * w[s] / total
        left -= sum(out[s] for s in over)
        open_ = open_ - over if over else set()
    return out


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(0.9)) % 3000)), rng.choice(["a", "b", "c", "é", "z", None]), "x") for i in range(1500)]
    rows += [(9000 + i, "same text here", "a", "x") for i in range(800)] + [(None, None, "b", "x"), (9000, "same text here", "a", "x"), (7, "one", "tiny", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target, least = defaultdict(int), defaultdict(int), {}, defaultdict(lambda: 10**9)
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        least[r["source"]] = min(least[r["source"]], r["size"] or 10**9)
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) <= 1e-6 * (1 + want[s])
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 3 * least[s]
    again = M.mix(df.repartition(5)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["copies"]) for r in rs)
    assert key(got) == key(again)
    rows_out = M.mixed_rows(df)
    assert rows_out.columns == df.columns and rows_out.count() == sum(r["copies"] for r in got)


def test_empty(spark):
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in M.mix(df).collect()] == [(0, 0.0)]
    assert M.mix(df.where("false")).collect() == []


def test_clashing_columns_and_row_order(spark):
    """Columns named like the operator's own and its inner ones; any order of rows and partitions gives the same mix."""
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 3}", -i, f"x{i}", i, i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, b string, copies long, bin long, _h long")
    runs = [{r["doc_id"]: (r["n"], r["b"], r["bin"], r["_h"], r["taken"], r["copies"]) for r in M.mix(d).collect()} for d in (df, df.orderBy("b").repartition(7))]
    assert runs[0] == runs[1] and all(v[:4] == (-i, f"x{i}", i, i) for i, v in runs[0].items())
