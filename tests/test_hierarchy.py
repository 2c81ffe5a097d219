"""Alias chains and edits of hierarchies: circles, absent targets, refused edits, nulls and empty tables."""

import random

import pytest

from sightline.operators import hierarchy as H

ENTS = "project_id int, id long, name string, status string, alias_of long, mentions long, suggested_parent string"


@pytest.mark.parametrize("seed", range(3))
def test_chains_end_as_a_walk_does(spark, seed):
    rng = random.Random(seed)
    to = {i: rng.choice([None, rng.randrange(-3, 120), i + 1, i]) for i in range(100)}
    want = {}
    for i in to:
        path = [i]
        while to[path[-1]] is not None and to[path[-1]] in to and to[path[-1]] not in path:
            path.append(to[path[-1]])
        nxt = to[path[-1]]
        circle = nxt is not None and nxt in to
        want[i] = (min(path[path.index(nxt) :]), True) if circle else (path[-1], False)
    df = spark.createDataFrame(list(to.items()), "id long, alias_of long").repartition(3)
    assert {r["node"]: (r["root"], r["cyclic"]) for r in H.chain_ends(df).collect()} == want


def test_long_chain_and_names(spark):
    df = spark.range(300).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS alias_of", "1L AS mentions")
    assert [tuple(r) for r in H.totals_by_root(df).collect()] == [(0, 1, 300, 300)]
    names = spark.createDataFrame([("a", "b"), ("b", None), ("c", "c"), (None, "a")], "id string, alias_of string")
    assert {tuple(r) for r in H.chain_ends(names).collect()} == {("a", "b", False), ("b", "b", False), ("c", "c", True)}
    assert H.chain_ends(df.where("false")).collect() == []


def test_edits_of_entities(spark):
    e = spark.createDataFrame([
        (1, 1, "Main", "pending", None, 5, "x"), (1, 2, "Sub", "sub_brand", None, 3, None), (1, 3, "sub alias", "alias", 2, 2, None), (1, 4, "other", "alias", 1, 4, "y"), (2, 5, "Sub", "alias", 9, 1, None), (1, 6, None, "alias", 2, 7, None)], ENTS)
    subs = spark.createDataFrame([(1, "Main", "Sub", ["own"]), (1, "Main", "Ghost", None)], "project_id int, parent string, name string, aliases array<string>")
    assert {r["name"]: r["aliases"] for r in H.enriched(subs, e).collect()} == {"Sub": ["own", "sub alias"], "Ghost": []}
    seen = spark.createDataFrame([(1, "sub alias"), (1, "sub alias"), (1, "Main"), (1, None)], "project_id int, name string")
    got = {r["id"]: (r["alias_of"], r["status"]) for r in H.reset_seen(e, seen).collect()}
    assert got == {1: (None, "pending"), 2: (None, "sub_brand"), 3: (None, "pending"), 4: (1, "alias"), 5: (9, "alias"), 6: (2, "alias")}
    rows = H.reset_subs(e, subs).collect()
    assert {r["id"]: (r["alias_of"], r["status"]) for r in rows} == {1: (None, "pending"), 2: (None, "confirmed"), 3: (None, "confirmed"), 4: (1, "alias"), 5: (9, "alias"), 6: (None, "confirmed")}
    assert all(r["suggested_parent"] is None for r in rows)
    tracked = spark.createDataFrame([(1, "Main", "M")], "project_id int, name string, key string")
    counts = spark.createDataFrame([(1, "M", 10), (1, "M::Sub", 100), (2, "M", 1000)], "project_id int, key string, n long")
    assert [tuple(r) for r in H.mention_totals(counts, tracked, subs, e).collect()] == [(1, "Main", 10, 14, 14 + 100 + 2 + 7)]


def test_moves_and_suggestions(spark):
    subs = spark.createDataFrame([(1, "A", "s", ["x"]), (1, "A", "t", ["y"]), (1, "B", "u", [])], "project_id int, parent string, name string, aliases array<string>")
    parents = spark.createDataFrame([(1, "A"), (1, "B")], "project_id int, name string")
    moves = spark.createDataFrame([(1, "s", "A", "B"), (1, "t", "A", "A"), (1, "u", "A", "B"), (1, "none", "A", "B"), (1, "v", "B", "C")], "project_id int, name string, from_parent string, to_parent string")
    out, refused = H.move_subs(subs, moves, parents)
    assert {(r["name"], r["parent"], tuple(r["aliases"])) for r in out.collect()} == {("s", "B", ()), ("t", "A", ("y",)), ("u", "B", ())}
    assert {(r["name"], r["reason"]) for r in refused.collect()} == {("u", "no such sub-brand"), ("none", "no such sub-brand"), ("v", "no such sub-brand")}
    e = spark.createDataFrame([(1, 1, 'The "Shop"', "p", None, 1, None), (1, 2, "Bar", "p", None, 1, None)], ENTS)
    s = spark.createDataFrame([(1, "The Shop", "A", "high"), (1, "'Bar'", "B", None), (1, "Bar", "C", "low"), (1, "Foo", "A", None), (1, None, "A", None)], "project_id int, entity string, parent string, confidence string")
    assert {tuple(r) for r in H.valid_suggestions(s, e, parents).collect()} == {(1, 'The "Shop"', "A", "high"), (1, "Bar", "B", "medium")}


def test_scenarios(spark):
    s = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (2, "a", None)], "project_id int, name string, parent string")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, None)], "project_id int, category string")
    edits = spark.createDataFrame([(1, "a", "z"), (1, "b", "a"), (1, "q", "r"), (1, "c", "c")], "project_id int, name string, new_name string")
    out, moved, refused = H.rename_scenarios(s, rows, edits)
    assert {tuple(r) for r in out.select("project_id", "name", "parent").collect()} == {(1, "z", None), (1, "b", "z"), (1, "c", "b"), (2, "a", None)}
    assert sorted(str(tuple(r)) for r in moved.select("project_id", "category").collect()) == sorted(map(str, [(1, "z"), (1, "b"), (2, "a"), (1, None)]))
    assert {(r["name"], r["reason"]) for r in refused.collect()} == {("b", "name taken"), ("q", "no such scenario")}
    edits = spark.createDataFrame([(1, "a", "c"), (1, "b", "b"), (1, "c", None), (2, "a", "x"), (2, "y", "a")], "project_id int, name string, parent string")
    out, refused = H.set_parents(s, edits)
    assert {tuple(r) for r in out.collect()} == {(1, "a", "c"), (1, "b", "a"), (1, "c", None), (2, "a", None)}
    assert {(r["project_id"], r["name"], r["reason"]) for r in refused.collect()} == {(1, "b", "own parent"), (2, "a", "unknown parent"), (2, "y", "no such scenario")}
    out, refused = H.set_parents(s, spark.createDataFrame([(1, "a", "c")], "project_id int, name string, parent string"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in s.collect()} and [tuple(r) for r in refused.collect()] == [(1, "a", "circle")]
    k = spark.createDataFrame([(1, "a", "__brand__"), (1, "b", "__brand__"), (2, "c", "__brand__::x"), (3, "d", "C"), (4, "e", None)], "cluster int, name string, key string")
    assert tuple(H.consolidation_summary(k).first()) == (4, 1, 2, 1, 1)
    assert tuple(H.consolidation_summary(k.where("false")).first()) == (0, 0, 0, 0, 0)
