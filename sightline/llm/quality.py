"""Line-first quality rules, as DataFrame expressions only.

Each line of a text is judged on its own (symbols, shouting, navigation, boilerplate, missing sentence ends); failing
lines are taken out, and a document goes when too much of its text went with them or when the base rules reject it.

Defined results: a null text is an empty text (no words, base_failed). A text of white space is the same. Rows are
judged alone, so repeated rows get equal results; columns beside the text are passed through, and the operator's own
columns replace input columns of the same name. Any length works: all work inside a row is linear in it, or n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.words import SPACE, words

#: Phrases of page furniture; a short line that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (?:use|service)|cookie|javascript|copyright|subscribe|sign up|log ?in|"
    "click here|read more|share this|powered by|back to top|newsletter"
)


@dataclass(frozen=True)
class LineRules:
    max_symbol_share: float = 0.1  # symbols [#*$%&|<>] a word
    max_shout_share: float = 0.3  # words that end in '!!' or '??' or more, of all words
    min_nav_bars: int = 3  # separators ' | ' (or ' > ', ' » ', ' · ') that make a line navigation
    boilerplate_words: int = 20  # a line of at most so many words with such a phrase fails
    unended_words: int = 40  # a line of more words than this without any sentence end fails
    max_lost_share: float = 0.3  # of the word characters of a document


SYMBOLS = r"[#*$%&|<>]"


def line_fails(line: Column, r: LineRules) -> Column:
    """Whether one line fails a rule. Counts are taken by regular expressions, so no array is built for a line."""
    n = F.regexp_count(line, F.lit(r"[^ \t-\r]++"))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2,}(?=[ \t-\r]|$)"))
    bars = F.regexp_count(line, F.lit(r"(?<=[ \t])[|>»·](?=[ \t])"))
    return (
        (symbols > n * r.max_symbol_share)
        | (shouts > n * r.max_shout_share)
        | (bars >= r.min_nav_bars)
        | ((n <= r.boilerplate_words) & F.lower(line).rlike(BOILERPLATE))
        | ((n > r.unended_words) & ~line.rlike(r"[.!?…。:;]"))
    )


def repeat_words(w: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more in the text, the first included.

    Windows are compared by a 64-bit hash of their words; positions of equal windows are neighbours once (hash, position)
    is sorted, and covered words are counted from the gaps between the sorted positions.
    """
    hashes = F.when(
        F.size(w) >= n,
        F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)])), 1, F.size(w) - (n - 1)),
    ).otherwise(F.array().cast("array<bigint>"))
    return hashes


def covered(hashes: Column, n: int = 5) -> Column:
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def positions(p: Column) -> Column:
        twice = F.transform(
            p,
            lambda x, i: F.when((F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["p"]),
        )
        return F.array_sort(F.array_compact(twice))

    def total(q: Column) -> Column:
        gaps = F.transform(q, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(q, i + 1) - x, F.lit(n))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    # one-element arrays bind a value once inside an expression
    bound = F.transform(F.array(pairs), positions)
    return F.transform(bound, total)[0]


def quality(df: DataFrame, text: str = "text", rules: LineRules | None = None) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text.

    clean_text is the text without failing lines; kept is false where the base rules fail or the lines that failed held
    more than max_lost_share of the word characters.
    """
    r = rules or LineRules()
    t = F.coalesce(F.col("_q_text"), F.lit(""))
    out = df.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_q_words", words(F.col("_q_text"))).withColumn("_q_lines", F.split("_q_text", "\n"))
    out = out.withColumn("_q_hashes", repeat_words(F.col("_q_words")))
    out = out.withColumns({
        "_q_worded": F.filter("_q_lines", lambda x: x.rlike(r"[^ \t-\r]")),
        "_q_good": F.filter("_q_lines", lambda x: ~line_fails(x, r)),
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_repeat_words": F.when(
            F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"), covered(F.col("_q_hashes"))
        ).otherwise(F.lit(0).cast("long")),
    })
    out = out.withColumn("clean_text", F.array_join("_q_good", "\n"))
    out = out.withColumns({
        "n_dup_lines": (F.size("_q_worded") - F.size(F.array_distinct("_q_worded"))).cast("long"),
        "base_failed": (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
        "_q_left": F.length("clean_text") - F.regexp_count("clean_text", F.lit(SPACE)),
    })
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "_q_left"]
    # a one-row explode keeps filters on the results above it; pushed down, they would copy the window hashing into themselves
    row = F.explode_outer(F.array(F.struct(*own))).alias("_q_row")
    out = out.select(*[c for c in df.columns if c not in {*own, "kept"}], row).select("*", "_q_row.*").drop("_q_row")
    lost = F.col("word_chars") - F.col("_q_left")
    kept = ~F.col("base_failed") & (lost <= F.col("word_chars") * r.max_lost_share)
    return out.withColumn("kept", kept).drop("_q_left")


OP6_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*OP6_COLUMNS)


#: The same rules for DuckDB; LineRules' defaults are written out.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS s FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS o(k) GROUP BY rid),
lines AS (SELECT rid, p, string_split(text, chr(10))[p] AS line FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(p)),
worded AS (SELECT rid, count(*) - count(DISTINCT line) AS dups FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
judged AS (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
good AS (SELECT rid, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS left_chars FROM judged WHERE NOT (
  len(regexp_extract_all(line, '[#*$%&|<>]')) > n * 0.1
  OR len(regexp_extract_all(line || ' ', '[!?]{2,}[\x20\x09-\x0D]')) > n * 0.3
  OR len(regexp_extract_all(regexp_replace(line, '[\x20\x09]', '  ', 'g'), '[\x20\x09][|>»·][\x20\x09]')) >= 3
  OR (n <= 20 AND regexp_matches(lower(line), 'all rights reserved|privacy policy|terms of (?:use|service)|cookie|javascript|copyright|subscribe|sign up|log ?in|click here|read more|share this|powered by|back to top|newsletter'))
  OR (n > 40 AND NOT regexp_matches(line, '[.!?…。:;]'))) GROUP BY rid),
m AS (SELECT d.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN worded USING (rid) LEFT JOIN good USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars - left_chars <= word_chars * 0.3 AS kept
FROM m
"""
