"""Text columns of the answer analysis; all are expressions, offsets are 0-based code points and -1 where there is none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits that bound a name.
EDGE = "а-яА-ЯёЁa-zA-Z0-9"
# Patterns of list structures.
NUMBERED = r"(?m)^\s*(\d+)\s*[.):\-]\s+(.+)$"
BULLET = r"(?m)^\s*[-*•]\s+(.+)$"
TABLE_ROW = r"(?m)^\s*\|(.+)\|\s*$"
TABLE_RULE = r"(?m)^\s*\|[\s\-:|]+\|\s*$"
# Refusal phrases, Russian and English, each with words of which a text that has it holds one.
REFUSALS = {
    r"я\s+(?:ии|искусственный интеллект|языковая модель)": ("ии", "искусственный", "языковая"),
    r"не\s+(?:могу|даю|предоставляю)\s+(?:финансовых?|медицинских?|юридических?)": ("финансов", "медицинск", "юридическ"),
    r"обратитесь\s+к\s+(?:специалисту|врачу|юристу)": ("обратитесь",),
    r"я\s+не\s+(?:могу|имею права)\s+(?:рекомендовать|советовать)": ("рекомендовать", "советовать"),
    r"не\s+является\s+(?:финансовой|медицинской|юридической)\s+(?:консультацией|рекомендацией)": ("является",),
    r"i(?:'m|\s+am)\s+(?:an?\s+)?(?:ai|artificial intelligence|language model)": ("ai", "artificial", "language"),
    r"(?:can(?:'t|not)|unable to)\s+(?:provide|give|offer)\s+(?:financial|medical|legal)": ("financial", "medical", "legal"),
    r"consult\s+(?:a|your)\s+(?:professional|doctor|lawyer|advisor)": ("consult",),
    r"not\s+(?:financial|medical|legal)\s+advice": ("advice",),
    r"i\s+(?:can(?:'t|not)|am unable to)\s+(?:recommend|advise)": ("recommend", "advise"),
}
CENSORED = ("[CENSORED_BY_VENDOR]", "[CENSORED]", "[BLOCKED]")
# Phrases that class a mention.
RECOMMENDED = r"рекоменду[юем]|лучший выбор|топ[- ]?\d|лидер|лучше всего|recommend|best choice|top pick|leader|number one|#\s*1"
COMPARED = (
    r"сравнени[ие]|сравни[мтв]|в отличие от|по сравнению|альтернатив[аы]|vs\.?|versus|compar|unlike|alternative|instead of|rather than|"
    r"преимуществ\w*\s+и\s+недостат|плюс\w*\s+и\s+минус|pros?\s+and\s+cons?|(?:у\s+)?каждого\s+(?:из\s+них\s+)?(?:есть\s+)?сво[ией]"
)
NEGATIVE = r"недостат[коки]|проблем[аы]|минус[ыа]|слаб[оые]|хуже|не рекоменду|disadvantage|problem|issue|weak|worse|not recommend|drawback|downside"
# Words that score a context.
GOOD = (
    "лучший отличный надёжный надежный удобный быстрый рекомендую популярный качественный безопасный выгодный топ лидер превосходный идеальный "
    "best excellent reliable convenient fast recommend recommended popular quality safe leader top superior ideal great outstanding trusted leading"
).split()
BAD = (
    "худший плохой медленный дорогой ненадёжный ненадежный проблема проблемы минус минусы недостаток недостатки опасный рискованный устаревший неудобный сложный "
    "worst bad slow expensive unreliable problem problems disadvantage disadvantages drawback drawbacks dangerous risky outdated complex difficult poor issue issues worse"
).split()
# Tags of a context, and the words of which a context that has the tag holds one.
TAGS = {
    "price": r"цен[аы]|стоимость|тариф|price|cost|pricing|cheap|expensive|fee",
    "quality": r"качеств|quality|reliable|надёжн|надежн",
    "support": r"поддержк|support|customer service|помощь",
    "speed": r"скорость|быстр|speed|fast|performance|производительн",
    "features": r"функци|feature|возможност|capability|инструмент|tool",
    "security": r"безопасн|security|защит|encryption|шифрован",
    "ease_of_use": r"удобн|простот|ease|user.friendly|интуитивн|intuitive|usability",
    "integration": r"интеграци|integration|api|подключен|connect",
}
TAG_WORDS = {
    "price": "цен стоимость тариф pric cost cheap expensive fee",
    "quality": "качеств quality reliable надёжн надежн",
    "support": "поддержк support customer помощь",
    "speed": "скорость быстр speed fast performance производительн",
    "features": "функци feature возможност capability инструмент tool",
    "security": "безопасн security защит encryption шифрован",
    "ease_of_use": "удобн простот ease friendly интуитивн intuitive usability",
    "integration": "интеграци integration api подключен connect",
}
# Letters that equal others where a pattern ignores case, though lower() keeps them apart.
ODD = "[\u0130\u0131\u017f\u212a\u1c80-\u1c88]"


def bind(value: Column, f) -> Column:
    """f(value) with value computed once, however often f refers to it (filters that move down a plan copy whole expressions)."""
    return F.transform(F.array(value), f)[0]


def odd(text: Column) -> Column:
    """Whether a text has one of ODD; those of one byte a letter have none."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(ODD)


def folded(text: Column) -> Column:
    """What holds() looks at: the text in lower case, whether it has letters beyond ASCII, and whether one of them is ODD."""
    return F.struct(F.lower(text).alias("low"), (F.octet_length(text) > F.length(text)).alias("wide"), odd(text).alias("odd"))


def holds(x: Column, words) -> Column:
    """Whether a folded text may hold one of the words. A plain search is many times cheaper than a pattern that ignores case."""
    any_of = lambda ws: reduce(lambda a, b: a | b, [F.contains(x["low"], F.lit(w)) for w in ws], F.lit(False))
    return any_of([w for w in words if w.isascii()]) | (x["wide"] & (x["odd"] | any_of([w for w in words if not w.isascii()])))


def sanitize(text: Column) -> Column:
    """struct(flag, clean) of an answer."""

    def judged(t: Column) -> Column:
        stripped = F.contains(F.lower(t), F.lit("<think>")) & t.rlike(r"(?is)<think>.*?</think>")
        thought = F.regexp_replace(F.regexp_replace(t, r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")
        return bind(F.struct(stripped.alias("s"), F.when(stripped, thought).otherwise(t).alias("b")), lambda x: flagged(t, x["s"], x["b"]))

    def flagged(t: Column, stripped: Column, body: Column) -> Column:
        # a pattern runs over the few texts that hold one of its words
        refusals = bind(folded(body), lambda x: sum(((holds(x, words) & body.rlike("(?iu)" + p)).cast("int") for p, words in REFUSALS.items()), F.lit(0)))
        listed = body.rlike(r"(?m)^\s*\d+[.)]\s+") | body.rlike(r"(?m)^\s*[-*•]\s+")
        censored = F.lit(False)
        for marker in CENSORED:
            censored = censored | t.contains(marker)
        refused = bind(refusals, lambda n: (n >= 2) | ((n >= 1) & (F.length(body) < 200) & ~listed))
        flag = (
            F.when(~t.rlike(r"\S"), "empty_response")
            .when(censored, "censored")
            .when(stripped & (body == ""), "empty_response")
            .when(refused, "vendor_refusal")
            .when(stripped, "think_stripped")
            .otherwise("clean")
        )
        clean = F.regexp_replace(body, r"\*{1,3}(.*?)\*{1,3}", "$1")
        clean = bind(clean, lambda c: F.when(F.contains(c, F.lit("\n\n\n")), F.regexp_replace(c, r"\n{3,}", "\n\n")).otherwise(c))
        clean = F.regexp_replace(clean, r"(?m)^[ \t]+|[ \t]+$", "")
        clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
        kept = lambda f: F.when(f.isin("empty_response", "censored"), "").when(f == "vendor_refusal", body).otherwise(clean)
        return bind(flag, lambda f: F.struct(f.alias("flag"), kept(f).alias("clean")))

    return bind(F.coalesce(text, F.lit("")), judged)


def structure(text: Column) -> Column:
    numbered = F.regexp_count(text, F.lit(NUMBERED)) >= 2  # four patterns at most: `text` should be a column or bound
    bullets = F.regexp_count(text, F.lit(BULLET)) >= 2
    table = (F.regexp_count(text, F.lit(TABLE_ROW)) >= 2) & (F.regexp_count(text, F.lit(TABLE_RULE)) >= 1)
    return (
        F.when(table & ~numbered & ~bullets, "table").when(numbered & ~bullets, "numbered_list").when(bullets & ~numbered, "bulleted_list").when(numbered & bullets, "mixed").otherwise("narrative")
    )


def list_items(text: Column, kind: Column) -> Column:
    """Items in rank order: by number (stable), bullets as they come, first cells of table rows but rules."""
    # zipped, so that each pattern runs once a text and not once an item
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(2)).alias("x"))
    ordered = F.array_sort(F.transform(pairs, lambda y, i: F.struct(y["n"].cast("bigint").alias("n"), i.alias("i"), F.trim(y["x"]).alias("x"))))
    by_number = F.transform(ordered, lambda y: y["x"])
    bullets = F.transform(F.regexp_extract_all(text, F.lit(BULLET), F.lit(1)), lambda x: F.trim(x))
    cells = F.transform(F.regexp_extract_all(text, F.lit(TABLE_ROW), F.lit(1)), lambda r: F.filter(F.transform(F.split(r, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: c.rlike(r"[^\s:-]")))
    return (
        F.when(kind.isin("numbered_list", "mixed"), by_number).when(kind == "bulleted_list", bullets).when(kind == "table", F.transform(rows, lambda r: r[0])).otherwise(F.array().cast("array<string>"))
    )


def bounded(name: Column) -> Column:
    """Pattern of a name that no letter or digit touches, case-folded. It begins with the name, as looking behind at every place of a text is slow."""
    return F.concat(F.lit(r"(?iu)\Q"), name, F.lit(rf"\E(?<![{EDGE}]\Q"), name, F.lit(rf"\E)(?![{EDGE}])"))


def may_hold(text: Column, name: Column) -> Column:
    """Whether bounded(name) may be found in a text: false where lower case rules it out. Letters that lower() does not tell of leave it open."""
    return F.contains(F.lower(text), F.lower(name)) | name.rlike(r"[^\x00-\x7Fа-яА-ЯёЁ]") | odd(text)


def offset(text: Column, name: Column) -> Column:
    return F.when(may_hold(text, name), F.regexp_instr(text, bounded(name)) - 1).when(text.isNotNull() & name.isNotNull(), -1).cast("long")


def context(text: Column, at: Column, reach: int = 500) -> Column:
    start = F.greatest(F.lit(0), at - reach)
    return F.when(at >= 0, F.regexp_replace(F.substr(text, (start + 1).cast("int"), (at + reach - start).cast("int")), r"^\s+|\s+$", ""))


def sentence_index(text: Column, at: Column) -> Column:
    return F.when(at >= 0, F.regexp_count(F.left(text, at.cast("int")), F.lit(r"[.!?]\s+")).cast("long"))


def mention_class(ctx: Column) -> Column:
    i = "(?iU)"
    return F.when(ctx.isNull(), "none").when(ctx.rlike(i + RECOMMENDED), "recommended").when(ctx.rlike(i + COMPARED), "compared").when(ctx.rlike(i + NEGATIVE), "negative").otherwise("direct")


def position_weight(kind: Column, rank: Column, at: Column, length: Column) -> Column:
    """Weight of a mention: by rank in numbered lists, even in bullets, by place in prose; 0.3 for names outside the list."""
    numbered = F.when(rank >= 10, 0.1).otherwise(F.round(F.lit(1.0) - (rank - 1) * 0.1, 1))
    ratio = at / F.nullif(length, F.lit(0))
    prose = F.when(ratio.isNull(), 0.5).when(ratio < 0.2, 1.0).when(ratio < 0.5, 0.7).when(ratio < 0.8, 0.4).otherwise(0.2)
    return F.when(at < 0, 0.0).when(kind == "narrative", prose).when(rank <= 0, 0.3).when(kind == "bulleted_list", 0.8).otherwise(numbered)


def lexicon_score(ctx: Column) -> Column:
    """(good - bad) / (good + bad) of the distinct lexicon words in a context. A pattern looks for a word only where a plain search finds its letters."""
    letters = "а-яА-ЯёЁa-zA-Z"

    def scored(x: Column) -> Column:
        whole = lambda w: (F.lit(True) if w.isascii() else x["wide"]) & F.contains(x["low"], F.lit(w)) & x["low"].rlike(f"{w}(?<![{letters}]{w})(?![{letters}])")
        hits = lambda words: F.size(F.array_compact(F.array(*[F.when(whole(w), F.lit(1)) for w in words])))
        return bind(F.struct(hits(GOOD).alias("g"), hits(BAD).alias("b")), lambda n: F.try_divide((n["g"] - n["b"]).cast("double"), (n["g"] + n["b"]).cast("double")))

    return F.coalesce(F.round(bind(folded(ctx), scored), 2), F.lit(0.0))


def sentiment(score: Column) -> Column:
    return F.when(score > 0.25, "positive").when(score < -0.25, "negative").when(F.abs(score) <= 0.1, "neutral").otherwise("mixed")


def multiplier(label: Column) -> Column:
    return F.when(label == "positive", 1.2).when(label == "negative", 0.5).when(label == "mixed", 0.8).otherwise(1.0)


def tags(ctx: Column) -> Column:
    return bind(folded(ctx), lambda x: F.array_compact(F.array(*[F.when(holds(x, TAG_WORDS[t].split()) & ctx.rlike("(?iu)" + p), t) for t, p in TAGS.items()])))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def citations(text: Column, native: Column) -> Column:
    """Distinct URLs in order: native ones, Markdown links, footnotes with a definition, bare URLs."""
    links = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\((https?://[^\s\)]+)\)"), F.lit(2))
    definition = r"(?m)^\s*\[\^?(\d+)\]:?\s+(https?://\S+)"
    notes = F.arrays_zip(F.regexp_extract_all(text, F.lit(definition), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(definition), F.lit(2)).alias("u"))
    # the last definition of a number counts; one-element arrays bind the list once
    marks = F.regexp_extract_all(text, F.lit(r"\[\^?(\d+)\]"), F.lit(1))
    found = F.transform(F.array(notes), lambda d: F.transform(marks, lambda k: F.try_element_at(F.filter(d, lambda z: z["k"] == k), F.lit(-1))["u"]))[0]
    marked = F.array_compact(found)
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\()(https?://[^\s\)\]\"'>]+)"), F.lit(1)), lambda u: F.regexp_replace(u, "[.,;:]+$", ""))
    own = F.filter(F.transform(native, lambda u: F.trim(u)), lambda u: u != "")
    return F.array_distinct(F.concat(own, links, marked, bare))
