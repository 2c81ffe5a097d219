import random
import tracemalloc

import numpy as np

from sightline.llm import decontaminate as D
from sightline.llm.windows import Hasher


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_align():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        got = D.align(np.array(a), np.array(b))
        assert got[0] == brute_align(a, b)


def test_long_passage_takes_memory_in_proportion():
    """A text that quotes an item again and again is one passage; a whole matrix would take 200 x 400,000 cells."""
    item = np.arange(200)
    passage = np.concatenate([np.tile(item[:150], 2000), np.arange(1000, 101_000), item[:60], [7], item[61:]])
    tracemalloc.start()
    got = D.align(item, passage)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == (397, 199, len(passage) - 200, len(passage)) and peak < 40_000_000


def test_recall_of_edited_copies(spark):
    """Copies with every 3rd to 8th word changed, against alignment of every item with every text; and texts of the same words in another order."""
    rng = random.Random(9)
    items = [[f"{k}w{i}" for i in range(40)] for k in range(6)]
    docs, want = [], set()
    for d in range(120):
        item, every = items[d % 6], 3 + d % 6
        copy = [f"x{d}" if i % every == every - 1 else w for i, w in enumerate(item)]
        if d % 7 == 0:
            copy = rng.sample(item, len(item))
        docs.append([f"f{d}_{i}" for i in range(30)] + copy + ["end"])
        for i, x in enumerate(items):
            if D.align(np.array([hash(w) for w in x]), np.array([hash(w) for w in docs[-1]]))[1] / len(x) >= 0.8:
                want.add((d, i))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()}
    assert got <= want and {(d, i) for d, i in want if 3 + d % 6 > 5} <= got  # a changed word in five leaves no five-word seed
    assert len(got) >= 0.6 * len(want)


def test_word_hashes():
    h = Hasher(3)
    a, b = D.word_hashes("The “Quick” brown—fox, É!", h), D.word_hashes("the quick brown fox é", h)
    assert a.tolist() == b.tolist() and len(set(a.tolist())) == 5
    long = "word other " * 300_000
    assert len(set(D.word_hashes(long, h).tolist())) == 2


def test_pairs_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [words(rng.randrange(15, 40)) for _ in range(12)] + [words(3)]
    docs, want = [(0, None), (1, "")], set()
    for d in range(2, 80):
        w = words(rng.randrange(5, 200))
        if d % 2:
            k = rng.randrange(len(items))
            copy = list(items[k])
            for _ in range(rng.randrange(0, len(copy) // 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            at = rng.randrange(len(w) + 1)
            w = w[:at] + copy + w[at:]
        docs.append((d, " ".join(w).title() + "."))
    for d, t in docs:
        tokens = (t or "").lower().replace(".", "").split()
        for i, item in enumerate(items):
            shared = {tuple(item[x : x + 5]) for x in range(len(item) - 4)} & {tuple(tokens[x : x + 5]) for x in range(len(tokens))}
            if shared and D.align(np.array([hash(x) for x in item]), np.array([hash(x) for x in tokens]))[1] / len(item) >= 0.8:
                want.add((d, i))
    df = spark.createDataFrame([(*r, 1) for r in [*docs, docs[5], (None, " ".join(items[0]))]], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None), (98, "!")], "item_id long, text string")
    for limit in (10**6, 10):
        monkeypatch.setattr(D, "MAX_SEEDS", limit)
        got = [(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()]
        assert len(got) == len(set(got)) and set(got) == want | {(None, 0)}
    left = {r["doc_id"] for r in D.decontaminate(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert D.contaminated(df.where("false"), bench).collect() == [] and D.contaminated(df, bench.where("false")).collect() == []


def test_edited_copies_beside_verbatim_ones(spark, monkeypatch):
    items = [[f"w{i}" for i in range(30)], [f"v{i}" for i in range(28)]]
    edited = [[f"x{d}" if i % 5 == 0 and i else w for i, w in enumerate(items[0])] for d in range(20)]
    assert all(sum(a == b for a, b in zip(e, items[0])) == 25 for e in edited)
    common = items[0][:5] + items[1]  # shares a seed with the first item, but nothing else
    docs = [items[0], *edited, items[1], common, ["a", "b", *edited[0][:12]]]
    want = set()
    for d, w in enumerate(docs):
        for i, item in enumerate(items):
            shared = {tuple(item[x : x + 5]) for x in range(len(item) - 4)} & {tuple(w[x : x + 5]) for x in range(len(w))}
            if shared and D.align(np.array([hash(x) for x in item]), np.array([hash(x) for x in w]))[1] / len(item) >= 0.8:
                want.add((d, i))
    assert {(d, 0) for d in range(21)} <= want
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for limit in (10**6, 10):
        monkeypatch.setattr(D, "MAX_SEEDS", limit)
        assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()} == want
