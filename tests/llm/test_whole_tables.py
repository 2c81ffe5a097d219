"""Queries without SQL over a whole small table, against brute force."""

from collections import defaultdict

from sightline.llm.decontaminate import op7_decontamination
from sightline.llm.mixing import op2_mix_sources
from sightline.llm.simhash import op8_simhash_components
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, brute_fp


def test_op8(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_fp(t) for i, t in texts.items()}
    want = brute_components(fps)
    got = op8_simhash_components(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in texts} and len(got) == len(texts)


def test_op7_finds_verbatim_items_and_nothing_else(spark, sf_dir):
    words = lambda t: " ".join((t or "").lower().split())
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op7_decontamination(spark, sf_dir).collect()}
    assert whole and whole <= set(got) and all(got[k] == 1.0 for k in whole) and all(v >= 0.8 for v in got.values())


def test_op2(spark, sf_dir):
    got = op2_mix_sources(spark, sf_dir).collect()
    rows = {r["doc_id"]: (r["source"], len((r["text"] or "").encode().split())) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in got} == {i: n for i, (_, n) in rows.items()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = rows[r["doc_id"]][0]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) <= 1e-6 * (1 + want[s])
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + min(n for x, n in rows.values() if x == s)
