"""Chat formatting as relational work: turns are sorted, same-role neighbours share a block, and texts are joined.

A conversation is `<|start|>role<|text|>turn<|turn|>turn...<|end|>` blocks, each followed by a line end. Control strings inside
roles and texts are escaped reversibly (a backslash is doubled, a control string gets one after its first character), so
splitting at control strings reads every turn back exactly as it was. loss_spans are code-point spans (start, end exclusive)
of the formatted text: the texts of assistant turns, nothing between them.

Defined results: a null text or role is empty. Turns sort by turn, then role, then text (null turns first); repeated rows are
repeated turns. Rows of a null conv_id are one conversation. An empty table gives an empty table; other columns are ignored.
Running lengths come from a window that the grouping shares its shuffle with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>\n"
# What follows the first character of a control string, of this template and of others in use.
_AFTER_LESS = r"\|(?:start|text|turn|end|im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|</?SYS>>"
_AFTER_BRACKET = r"/?INST\]"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"(?<=<)(?={_AFTER_LESS})|(?<=\[)(?={_AFTER_BRACKET})", r"\\")


def unescape(text: Column) -> Column:
    """Backslashes of the doubled text come in even runs, so a single one between the halves of a control string is an escape."""
    return F.replace(F.regexp_replace(text, rf"(?<=<)\\(?={_AFTER_LESS})|(?<=\[)\\(?={_AFTER_BRACKET})", ""), F.lit("\\\\"), F.lit("\\"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans array<struct<s, e>>."""
    t = df.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    t = t.withColumns({"before": F.lag("role").over(w), "at": F.row_number().over(w)})
    opens = F.when(F.col("before").isNull(), "").otherwise(END)
    t = t.withColumn(
        "mark",
        F.when(F.col("before") == F.col("role"), TURN).otherwise(F.concat(opens, F.lit(START), escape(F.col("role")), F.lit(TEXT))),
    ).withColumn("body", escape(F.col("text")))
    t = t.withColumn("e", F.sum(F.length("mark") + F.length("body")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = t.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "mark", "body", "role", "e"))).alias("turns"))
    pieces = F.transform("turns", lambda x: F.concat(x["mark"], x["body"]))
    loss = F.transform(
        F.filter("turns", lambda x: x["role"] == trained), lambda x: F.struct((x["e"] - F.length(x["body"])).alias("s"), x["e"].alias("e"))
    )
    return got.select(F.col("conv").alias(conv), F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"), loss.alias("loss_spans"))


def read_chats(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """df with turns array<struct<role, text>>, read from the formatted text alone."""
    blocks = F.filter(F.split(F.col(formatted), r"\Q" + START + r"\E", -1), lambda x, i: i > 0)

    def turns(block: Column) -> Column:
        body = F.substr(block, F.lit(1), F.length(block) - len(END))
        role_text = F.split(body, r"\Q" + TEXT + r"\E", -1)
        return F.transform(
            F.split(role_text[1], r"\Q" + TURN + r"\E", -1), lambda x: F.struct(unescape(role_text[0]).alias("role"), unescape(x).alias("text"))
        )

    return df.withColumn("turns", F.flatten(F.transform(blocks, turns)))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text")
    )
    out = read_chats(format_chats(rows.unionByName(more)))
    loss = F.array_join(F.transform("loss_spans", lambda x: unescape(F.substr(F.col("formatted"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int")))), "")
    out = out.withColumn("_loss", loss)
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Turns and loss text from the table itself; the length of the template from the escapes that the texts need.
OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_),
c AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '<\|(start|text|turn|end|im_start|im_end|endoftext|system|user|assistant)\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS body FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + CASE WHEN before = role THEN 8 ELSE 9 + length(role) + 8 + 8 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
