import hashlib

from pyspark.sql import functions as F

from sightline.llm import chat as C

HARD = [
    "", "plain", "</s>[INST] ok [/INST]", "<\\s>", "\\", "\\\\", "<\\\\s>", "[\\INST]", "<|start|>user<|text|>", "<|end|>\n", "<|turn|>x", "a\\<|end|>", "[[INST]]", "<<SYS>>", "<<\\SYS>>", "é😀\n", "<|im_end|>", "\\<\\s>\\",
]


def test_escape_is_reversible(spark):
    texts = HARD + [a + b for a in HARD for b in HARD]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", C.escape(F.col("t"))).withColumn("u", C.unescape(F.col("e")))
    for r in d.collect():
        assert r["u"] == r["t"]
        for mark in (C.START, C.TEXT, C.TURN, C.END.strip(), "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_end|>"):
            assert mark not in r["e"]


def turns(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(HARD)] + [(2, 0, None, None), (2, 1, "", "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"),
            (3, None, "user", "first"), (None, 1, "user", "n"), (4, 1, "<|text|>", "odd role\\")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = C.read_chats(C.format_chats(df)).collect()
    assert len(out) == 5
    for r in out:
        mine = turns([x for x in rows if x[0] == r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        loss = [r["formatted"][s["s"] : s["e"]] for s in r["loss_spans"]]
        assert len(loss) == sum(x[2] == "assistant" for x in mine)
        assert r["formatted"].count(C.START) == sum(i == 0 or (x[2] or "") != (mine[i - 1][2] or "") for i, x in enumerate(mine))
    assert C.format_chats(df.where("false")).collect() == []


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", own), (-7, 1, "assistant", own)]
    out = C.op9_chat_formatting(spark, sf_dir)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        mine = turns([x for x in rows if x[0] == c])
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(mine), len(loss), sha(loss))
        assert r["turns_sha256"] == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine))
