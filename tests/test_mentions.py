"""Mentions, judges and traces on small cases."""

from pyspark.sql import functions as F

from sightline.operators import mentions as M


def test_parsed(spark):
    d = spark.createDataFrame([(1, '["A", {"name":"B","context":"c","type":"org"}, {"x":1}, {"name":"D"}]'), (2, "broken"), (3, None), (4, "[]")], "answer_id int, raw string")
    got = sorted(tuple(r) for r in M.parsed(d).collect())
    assert got == [(1, 0, "A", "", "other"), (1, 1, "B", "c", "org"), (1, 3, "D", "", "other")]


def test_by_entity_keeps_few_contexts(spark):
    rows = [(i, 0, "Acme." if i % 2 else "acme", f"c{i % 9}", "org") for i in range(50)] + [(60, 0, " ", "x", "org")]
    (r,) = M.by_entity(spark.createDataFrame(rows, "answer_id int, position int, name string, context string, type string")).collect()
    assert (r["key"], r["name"], r["mentions"], r["answers"], r["contexts"]) == ("acme", "acme", 50, 50, ["c0", "c1", "c2", "c3", "c4"])


def test_echo(spark):
    d = spark.createDataFrame([("Что такое яндекс?",), ("What is Yandeks?",), ("other",), (None,)], "p string")
    assert [r[0] for r in d.select(M.echoed(F.col("p"), [F.lit("Яндекс"), F.lit(None).cast("string"), F.lit("")])).collect()] == [True, True, False, False]


def test_fallback(spark):
    rows = [("Acme is the best choice", ""), ("avoid Acme", ""), ("Acme versus Rival, ideal", None), ("Acme versus none", ""), ("Acmeville", ""), ("Acme", "is acme ok"), (None, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, prompt string")
    got = [(r["brand_mentioned"], r["mention_type"], r["named"]) for r in M.fallback(d, F.lit("Acme"), ["Rival"]).orderBy("i").collect()]
    assert got == [(True, "recommended", []), (True, "negative", []), (True, "compared", ["Rival"]), (True, "direct", []), (False, "none", []), (False, "none", []), (False, "none", [])]


def test_judged_falls_back(spark):
    d = spark.createDataFrame([(0, "direct", 0.3, "positive", "[1]"), (1, "direct", 0.3, "positive", "{}"), (2, "direct", 0.3, "positive", None)], "i int, mention_type string, score double, label string, judge string")
    got = [(r["mention_type"], r["score"], r["label"], r["by_judge"]) for r in M.judged(d).orderBy("i").collect()]
    assert got == [("direct", 0.3, "positive", False), ("direct", 0.0, "neutral", True), ("direct", 0.3, "positive", False)]


def test_confirmed(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(['{"same_entity":true,"confidence":0.8}', '{"same_entity":true}', "x", None, '{"same_entity":true,"confidence":0.79}'])], "i int, verdict string")
    assert [r["i"] for r in M.confirmed(d).collect()] == [0]


def test_by_entity_reads_mentions_once(spark):
    m = spark.range(40).selectExpr("id % 7 AS answer_id", "id AS position", "concat('N', id % 3) AS name", "CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN NULL ELSE concat('c', id % 9) END AS context", "'org' AS type")
    d = M.by_entity(m, 3)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    want = {}
    for r in m.orderBy("answer_id", "position").collect():
        w = want.setdefault(r["name"].lower(), [r["name"], 0, set(), set()])
        w[1] += 1
        w[2].add(r["answer_id"])
        w[3] |= {r["context"]} - {"", None}
    assert {r["key"]: [r["name"], r["mentions"], r["answers"], r["contexts"]] for r in d.collect()} == {k: [n, c, len(a), sorted(x)[:3]] for k, (n, c, a, x) in want.items()}
