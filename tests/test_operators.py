"""Literal cases of single operators on tiny frames."""

from datetime import date

from pyspark.sql import functions as F

from sightline.functions import text as T
from sightline.operators import audit, ranks
from sightline.operators import visibility as V
from sightline.operators.answers import analyze

SNAP = (
    "query_id long, query_type string, day date, provider string, brand_mentioned boolean, mention_type string, competitor_mentions map<string,boolean>, cited_urls array<string>, "
    "sentiment_label string, position_rank long, structure_type string, is_hallucination boolean, category string, cost_usd double"
)


def snap(spark, rows):
    base = dict(query_id=1, query_type="custom", day=date(2024, 1, 1), provider="p", brand_mentioned=True, mention_type="direct", competitor_mentions=None, cited_urls=None,
                sentiment_label=None, position_rank=None, structure_type=None, is_hallucination=None, category=None, cost_usd=0.0)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], SNAP)


def test_aivs(spark):
    score = lambda rows: snap(spark, rows).agg(V.aivs().alias("a")).first()["a"]
    assert score([]) == 0.0
    assert score([{"mention_type": "recommended"}]) == 100.0  # 120 is capped
    assert score([{"mention_type": "direct"}, {"mention_type": "what"}]) == 35.0
    assert score([{"query_type": "comparison"}, {"query_type": "unknown", "mention_type": "none", "brand_mentioned": False}]) == 45.65


def test_counts_skip_sub_brands_and_false(spark):
    d = snap(spark, [{"competitor_mentions": {"A": True, "B": False, "A::x": True}}, {"brand_mentioned": False, "competitor_mentions": {"A": True}}, {"competitor_mentions": {}}])
    assert [tuple(r) for r in V.competitor_counts(d).collect()] == [("A", 2)]
    assert d.agg(V.share_of_model(d).alias("s")).first()["s"] == 50.0
    assert d.select(V.competitor_win().alias("w")).where("w").count() == 1


def test_rates_are_null_without_rows(spark):
    d = snap(spark, [{"structure_type": "narrative", "position_rank": 1}])
    assert d.agg(V.top1_rate().alias("t"), V.hallucination_rate().alias("h")).first()[:] == (None, None)
    d = snap(spark, [{"sentiment_label": "Positive"}, {"sentiment_label": "", "mention_type": "negative"}, {"mention_type": "none"}, {"sentiment_label": "mixed"}])
    assert d.agg(V.nss().alias("n")).first()["n"] == 0.0


def test_heatmap_and_graph(spark):
    d = snap(spark, [{"category": ""}, {"category": None, "cited_urls": ["https://www.A.com:80/x", "nonsense"]}, {"category": "c", "mention_type": "none", "brand_mentioned": False, "competitor_mentions": {"A::x": True}, "cited_urls": ["https://A.com:80/y"]}])
    got = {(r["scenario"], r["aivs"], r["zone"], r["total"]) for r in V.heatmap(d).collect()}
    assert got == {("Uncategorized", 70.0, "green", 2), ("c", 0.0, "red", 1)}
    assert [tuple(r) for r in V.citation_graph(d).collect()] == [("A.com:80", 2, "p", True)]


def test_resilience_averages_groups(spark):
    d = snap(spark, [{}, {"brand_mentioned": False}, {"query_id": 2}])
    assert V.resilience(d).first()[0] == 0.75
    assert V.resilience(d.where("false")).first()[0] == 0.0


TEXTS = {
    "numbered": "Intro\n2) Beta pays\n1. Acme is the best choice\n10. Last",
    "bullets": "- one\n* two Acme\n• three",
    "table": "| Name | x |\n|---|:-:|\n| Acme | 1 |\n| Beta | 2 |",
    "mixed": "1. Acme\n2. B\n- c\n- d",
    "prose": "Word. AcmeX is not it! But **acme** compared with others is fast, bad and reliable.",
    "think": "<think>Acme</think>  Nothing here",
    "blocked": "[BLOCKED] Acme",
    "refusal": "I am an AI. Consult a doctor.",
    "empty": " \n",
    "null": None,
}


def test_answers(spark):
    d = spark.createDataFrame(list(TEXTS.items()), "k string, text string")
    got = {r["k"]: r for r in analyze(d, F.lit("Acme")).collect()}
    assert {k: r["structure"] for k, r in got.items() if k in ("numbered", "bullets", "table", "mixed", "prose")} == {
        "numbered": "numbered_list", "bullets": "bulleted_list", "table": "table", "mixed": "mixed", "prose": "narrative"}
    assert got["numbered"]["items"] == ["Acme is the best choice", "Beta pays", "Last"] and got["numbered"]["rank"] == 1 and got["numbered"]["mention_type"] == "recommended"
    assert got["bullets"]["rank"] == 2 and got["bullets"]["weight"] == 0.8
    assert got["table"]["items"] == ["Name", "Acme", "Beta"] and got["table"]["rank"] == 2
    p = got["prose"]
    assert (p["at"], p["sentence"], p["mention_type"], p["score"], p["label"]) == (p["clean"].index("acme"), 2, "compared", 0.33, "positive")
    assert {k: got[k]["flag"] for k in ("think", "blocked", "refusal", "empty", "null", "prose")} == {
        "think": "think_stripped", "blocked": "censored", "refusal": "vendor_refusal", "empty": "empty_response", "null": "empty_response", "prose": "clean"}
    assert got["think"]["at"] == -1 and got["blocked"]["at"] == -1 and got["refusal"]["rvs"] == 0.0
    assert analyze(d.where("false"), F.lit("Acme")).collect() == []


def test_citations_in_order(spark):
    text = "See [A](https://a.com/x) and [1], https://b.com/y. Again https://a.com/x\n[1]: https://c.com/z"
    d = spark.createDataFrame([(text, [" https://n.com ", ""])], "t string, native array<string>")
    assert d.select(T.citations(F.col("t"), F.col("native"))).first()[0] == ["https://n.com", "https://a.com/x", "https://c.com/z", "https://b.com/y"]
    assert d.select(T.host(F.lit("https://WWW.A.com:80/x"))).first()[0] == "a.com"


def test_ranks(spark):
    r = spark.createDataFrame([(1, "g", date(2024, 1, 1), 5), (1, "g", date(2024, 1, 3), 0), (1, "g", date(2024, 1, 4), 2)], "keyword_id int, engine string, day date, position int")
    got = [(x["previous_position"], x["change"]) for x in ranks.previous_position(r).orderBy("day").collect()]
    assert got == [(None, None), (5, None), (0, None)]
    assert ranks.retained(r, "2024-02-10", 1).count() == 3 and ranks.retained(r, "2024-03-01", 1).count() == 0
    w = spark.createDataFrame([(1, 0, 0, None), (2, 10, 1, None), (2, 30, 3, 4.0)], "keyword_id int, impressions int, clicks int, position double")
    assert [tuple(x) for x in ranks.weighted(w).orderBy("keyword_id").collect()] == [(1, 0, 0, None, None), (2, 40, 4, 3.0, 10.0)]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nUser-agent: Other\nAllow: /\nDisallow: /private\n# x\nUser-agent: Third\nCrawl-delay: 2"
    d = spark.createDataFrame([("s", text), ("e", "")], "site string, robots string")
    got = {(r["site"], r["bot"]): r["allowed"] for r in audit.bot_access(d, ["GPTBot", "other", "Third", "Free"]).collect()}
    assert got == {("s", "GPTBot"): True, ("s", "other"): True, ("s", "Third"): None, ("s", "Free"): False, **{("e", b): None for b in ("GPTBot", "other", "Third", "Free")}}


def test_structured_types(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Article"},{"@type":["FAQPage","X"]}]}</script><script type="application/ld+json">[{"@type":"Product"}]</script><script type="application/ld+json">{bad</script>'
    d = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert sorted(r["type"] for r in audit.structured_types(d).collect()) == ["Article", "FAQPage", "Product"]


def test_upsert_stream(spark, sf_dir, tmp_path):
    from sightline.streaming.streams import deduplicated, event_stream, read_upserted, run_available, upsert_stream

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(2):
        events.where(f"event_id % 2 = {i}").coalesce(1).write.parquet(f"{tmp_path}/x/events{i}.parquet")
    stream = event_stream(spark, f"file://{tmp_path}/x/", "events0")
    assert stream.isStreaming
    out = deduplicated(event_stream(spark, sf_dir), ["user_id", "event_type"])
    assert run_available(out.groupBy("event_type").count()).count() == events.select("event_type").distinct().count()
    path = f"file://{tmp_path}/t"
    upsert_stream(event_stream(spark, sf_dir), path, ["user_id"], ["ts", "event_id"])
    got = read_upserted(spark, path, events.schema)
    want = {}
    for r in sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"])):
        want[r["user_id"]] = r["event_id"]
    assert {r["user_id"]: r["event_id"] for r in got.collect()} == want and got.count() == len(want) and got.columns == events.columns


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    import time
    from pathlib import Path

    from sightline.streaming.streams import read_upserted, upsert_stream

    path, source = f"file://{tmp_path}/t", f"file://{tmp_path}/in"
    put = lambda rows: spark.createDataFrame(rows, "k long, v long, n string").coalesce(1).write.mode("append").parquet(source)
    schema = "k long, v long, n string"
    put([(i, 1, "a") for i in range(200)] + [(None, 1, "a"), (None, 3, "b")])

    def run():
        upsert_stream(spark.readStream.schema(schema).parquet(source), path, ["k"], ["v"], 8)
        return {r["k"]: (r["v"], r["n"]) for r in read_upserted(spark, path, spark.createDataFrame([], schema).schema).collect()}

    assert run() == {**dict.fromkeys(range(200), (1, "a")), None: (3, "b")}
    files = lambda: {f for f in Path(f"{tmp_path}/t/data").rglob("*.parquet")}
    before = files()
    time.sleep(1.1)
    put([(5, 2, "new"), (5, 1, "old"), (500, 1, "c")])
    assert run() == {**dict.fromkeys(range(200), (1, "a")), None: (3, "b"), 5: (2, "new"), 500: (1, "c")}
    assert before <= files() and len(files() - before) <= 2  # one file for each of two buckets, in their other slots
    time.sleep(1.1)
    put([(5, 0, "late")])
    assert run()[5] == (2, "new")
    assert read_upserted(spark, f"{path}-none", spark.createDataFrame([], schema).schema).collect() == []
