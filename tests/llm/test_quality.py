import random
import re

from pyspark.sql import functions as F

from sightline.llm.quality import OP6_COLUMNS, op6_quality_rules, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "a b c d e a b c d e", "x " * 40, "é ü ß x " * 5, "l\nl\n\nl \n l"]
    for _ in range(120):
        n = rng.randrange(1, 60)
        t = "".join(rng.choice(["a", "b", "c", "dd", "é", "#"]) + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(n))
        texts.append(t)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int")
    got = quality(df).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in OP6_COLUMNS[1:7]) for r in got] == [brute(t) for t in texts]
    assert quality(df.where("false")).collect() == []


def test_lines_and_verdict(spark):
    good = "This is a plain sentence that ends as sentences do. " * 3
    rows = {
        "good": good + "\n" + good.upper().replace(".", "?") + "\nA title without an end",
        "nav": "Home | News | About | More\n" * 6 + "A short sentence stands here alone.",
        "shout": "BUY!! THIS!! NOW!! AND!! HERE!! OR!! THERE!! SO!! IT!! GOES!! ON!!",
        "symbols": "this*** is$$$ not### a&&& good%%% text*** at$$$ all### and&&& never%%% was***",
        "cookie": good + "\nWe use cookies to improve this site.",
        "long": "word and another one " * 30,
    }
    df = spark.createDataFrame(list(rows.items()), "k string, text string")
    got = {r["k"]: r for r in quality(df).collect()}
    assert {k for k, r in got.items() if r["kept"]} <= {"good", "cookie"} and got["cookie"]["clean_text"] == good
    assert not got["long"]["clean_text"]
    # a filter on the verdict keeps exactly the rows that the verdict keeps
    assert {r["k"] for r in quality(df).where("kept").collect()} == {k for k, r in got.items() if r["kept"]}


def test_long_text(spark):
    t = " ".join(f"w{i}" for i in range(60_000)) + "."
    d = spark.createDataFrame([(1, t), (2, "a " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality(d).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["kept"]) == (60_000, 0, True)
    assert (got[2]["n_words"], got[2]["n_repeat_words"], got[2]["kept"]) == (30_000, 30_000, False)


def test_plan_is_native_and_labels_agree(spark, sf_dir):
    out = op6_quality_rules(spark, sf_dir)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = out.join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert clean.where("kept").count() >= 0.98 * clean.count() > 0
    junk = out.join(labels, "doc_id").where("quality = 0")
    assert junk.where(~F.col("kept")).count() >= 0.9 * junk.count()
