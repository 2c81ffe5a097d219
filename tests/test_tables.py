import gzip
from datetime import date

from pyspark.sql import functions as F

from sightline.functions import json as J
from sightline.operators import consolidate as C
from sightline.sources import files as S


def test_rank_file(spark, tmp_path):
    text = "JM_PMETA\tOther\nkw\t1\tu0\nJM_PMETA\tИсходники\n KW One \t3\thttp://a\nkw2\tx\thttp://b\nkw3\t4\n\nkw4\t5\thttp://c\textra\n"
    with gzip.open(tmp_path / "r.txt.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    got = S.rank_file(spark, f"file://{tmp_path}/r.txt.gz").orderBy("position").collect()
    assert [(r["keyword"], r["position"], r["url"]) for r in got] == [("kw one", 3, "http://a"), ("kw4", 5, "http://c")]


def test_dumps(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"keys":["2024-01-02","q","p"],"impressions":3,"clicks":1,"position":2.5,"ctr":0.3}\n{"keys":["2024-01-02","q"]}\n')
    assert [tuple(r)[:4] for r in S.webmaster_dump(spark, f"file://{tmp_path}/g.json").collect()] == [(date(2024, 1, 2), "q", "p", 3)]
    (tmp_path / "y.json").write_text('{"query_text":" Q ","indicators":{"TOTAL_SHOWS":7.0}}\n')
    assert [tuple(r) for r in S.query_stats_dump(spark, f"file://{tmp_path}/y.json", "2024-01-03").collect()] == [(date(2024, 1, 2), "q", 7, 0, None)]


def test_exports_and_history(spark, tmp_path):
    d = spark.createDataFrame([("b", "g", date(2024, 1, 1), 0, None), ("a", "g", date(2024, 2, 1), 3, "u")], "keyword string, engine string, day date, position int, found_url string")
    S.write_positions_csv(d, f"file://{tmp_path}/csv")
    lines = [x for f in sorted((tmp_path / "csv").glob("part*")) for x in f.read_text().splitlines()[1:]]
    assert lines == ["a,g,2024-02-01,3,u", "b,g,2024-01-01,,"]
    S.append_history(d, f"file://{tmp_path}/h")
    S.append_history(d, f"file://{tmp_path}/h")
    got = S.read_history(spark, f"file://{tmp_path}/h", "2024-01-15", "2024-02-15")
    assert got.count() == 2 and "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().toString()


def test_json(spark):
    rows = ['{"a":1}', 'x ```json\n{"a":2}\n``` y', 'text {"a":3,} end', "none", None]
    d = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] and r[0]["a"] for r in d.select(J.lenient(F.col("t"), "a int")).collect()] == [1, 2, 3, None, None]
    e = spark.createDataFrame([('["n"," m ",""]',), ('[{"name":"x","context":"c","type":"t"},{"context":"d"}]',), (None,)], "t string")
    assert [[tuple(x) for x in r[0]] for r in e.select(J.entities(F.col("t"))).collect()] == [[("n", None, None), ("m", None, None)], [("x", "c", "t")], []]
    w = spark.createDataFrame([('[{"a":1},{"a":2},{"a":',)], "t string")
    assert w.select(J.whole_objects(F.col("t"))).first()[0] == ['{"a":1}', '{"a":2}']
    assert w.select(J.vector(F.lit("[1,2.5]"))).first()[0] == [1.0, 2.5]


def test_split_clusters(spark):
    rows = [("a1", "L", ["A"]), ("a2", "L", ["A"]), ("b", "L", ["B"]), ("n", "L", []), ("x", "M", ["X"]), ("y", "M", ["X"]), ("p", "P", []), ("q", "P", ["A", "B"])]
    got = {r["name"]: r["cluster"] for r in C.split_clusters(spark.createDataFrame(rows, "name string, leader string, roots array<string>")).collect()}
    assert got["a1"] == got["a2"] != got["b"] and got["n"] == "n:n" and got["x"] == got["y"] and got["p"] == got["q"]


def test_write_back(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "answer_id int")
    m = spark.createDataFrame([(1, "Me"), (1, "A::x"), (2, "B")], "answer_id int, key string")
    k = spark.createDataFrame([("Me",), ("A",), ("A::x",), ("B",)], "key string")
    got = {r["answer_id"]: (r["brand_mentioned"], {x for x, v in r["competitor_mentions"].items() if v}, len(r["competitor_mentions"])) for r in C.rebuild_flags(a, m, k, "Me").collect()}
    assert got == {1: (True, {"A", "A::x"}, 3), 2: (False, {"B"}, 3), 3: (False, set(), 3)}
    e = spark.createDataFrame([(1, "A", None, 5), (2, "a", 1, 2), (3, "B", None, 1), (4, "b", 3, 1)], "id int, name string, alias_of int, mentions int")
    assert {r["name"]: r["with_aliases"] for r in C.with_aliases(e).collect()} == {"A": 7, "B": 2}
    r = C.repoint_aliases(e, spark.createDataFrame([(3, 1)], "source int, target int"))
    assert {x["id"]: x["alias_of"] for x in r.collect()} == {1: None, 2: 1, 3: 1, 4: 1}
    d = spark.createDataFrame([("x-y", 3), ("x‑y", 5), ("z", 1)], "name string, mentions int")
    out = {r["canonical"]: (r["mentions"], r["variants"]) for r in C.dash_merge(d, F.regexp_replace("name", "‑", "-")).collect()}
    assert out == {"x‑y": (8, ["x-y"]), "z": (1, [])}
    s = spark.createDataFrame([("p", "promoted", 9, date(2024, 1, 2), date(2024, 1, 2)), ("n", "new", 1, date(2024, 1, 2), date(2024, 1, 2))], "name string, status string, mentions int, first_seen date, last_seen date")
    t = spark.createDataFrame([("p", "new", 4, date(2024, 1, 1), date(2024, 1, 5)), ("q", "new", 2, date(2024, 1, 5), date(2024, 1, 5))], s.schema)
    got = {x["name"]: tuple(x)[1:3] for x in C.rewrite_entities(s, t).collect()}
    assert got == {"p": ("promoted", 4), "n": ("new", 1), "q": ("new", 2)}
    assert {x["name"]: x["status"] for x in C.set_status(s, spark.createDataFrame([("n",)], "name string"), "rejected").collect()} == {"p": "promoted", "n": "rejected"}
    add, lacking = C.promoted(s, spark.createDataFrame([("k",)], "name string"))
    assert [x["name"] for x in add.collect()] == ["k"] and [x["name"] for x in lacking.collect()] == ["p"]


def test_known_names(spark):
    names = spark.createDataFrame([("Acme Inc",), ("акме",), ("Acme",), ("Globex",), ("Nobody Here",)], "name string")
    known = spark.createDataFrame([("Acme", "Acme", "Acme", 0), ("Globex Pro", "Globex::Pro", "Globex", 3), ("Globex", "Globex", "Globex", 2)], "name string, key string, root string, priority int")
    got = {r["name"]: r["roots"] for r in C.roots(names, known).collect()}
    assert got["Acme Inc"] == got["Acme"] == ["Acme"] and "Globex" in got["Globex"] and got["Nobody Here"] == []
    c = spark.createDataFrame([("Acme Inc", "c1"), ("Globex", "c1"), ("Nobody Here", "c2")], "name string, cluster string")
    assert {r["cluster"]: r["key"] for r in C.cluster_keys(c, known).collect()} == {"c1": "Acme", "c2": None}


def test_cache_verdicts_guard(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_key string")
    k = spark.createDataFrame([("a", date(2024, 1, 5)), ("b", date(2023, 1, 5)), ("a", date(2023, 1, 1))], "entity_key string, updated_at date")
    assert {r["entity_key"]: r["is_fresh"] for r in C.fresh_profiles(m, k, "2024-01-10").collect()} == {"a": True, "b": False, "c": False}
    e = spark.createDataFrame([(n, "new") for n in "abcde"], "name string, status string")
    v = spark.createDataFrame([("a", "z", None, True), ("b", None, "p", True), ("c", None, None, True), ("d", None, None, None)], "name string, alias_of string, parent string, is_competitor boolean")
    assert {r["name"]: r["status"] for r in C.apply_verdicts(e, v).collect()} == {"a": "alias", "b": "sub_brand", "c": "promoted", "d": "rejected", "e": "new"}
    g = spark.createDataFrame([("k", 1, "a", [1.0, 0.0]), ("k", 2, "b", [0.0, 1.0]), ("k", 3, "c", [0.9, 0.1]), ("k", 4, "d", None)], "cluster string, rank int, name string, v array<double>")
    assert {r["name"]: r["cluster"] for r in C.embedding_guard(g).collect()} == {"a": "k", "b": "n:b", "c": "k", "d": "k"}
