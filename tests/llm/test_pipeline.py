import corpus_pipeline as P
from sightline.llm.decontaminate import contaminated
from sightline.llm.quality import quality
from sightline.llm.simhash import near_duplicates
from sightline.sources.shared import written


def test_stages_on_a_small_table(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, seen = first, {}
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == first.columns
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert seen["quality rules"] == {r["doc_id"] for r in quality(first).where("kept").collect()}
    assert seen["quality rules"] >= seen["SimHash near-dedup"] >= seen["benchmark decontamination"] >= seen["mixing sources"]
    assert near_duplicates(docs.dropDuplicates(["doc_id"])).where("doc_id <> component_id").isEmpty()
    assert contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).isEmpty()
    out = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out)))
    assert sum(r["n_docs_ended"] for r in out) == docs.count()
