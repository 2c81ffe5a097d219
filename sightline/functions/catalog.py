"""Columns for URLs, domains, display names, dates and profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions import names as N

# What ends a sentence.
STOPS = ".!?…"
# Query types by subtype and by class, and where neither is known.
TYPE_OF_SUBTYPE = {
    "comparison": "comparison",
    "reputation": "brand_check",
    "negative": "brand_check",
    "fact_check": "brand_check",
    "category": "recommendation",
    "attribute": "recommendation",
    "scenario": "recommendation",
    "event": "recommendation",
}
TYPE_OF_CLASS = {"thematic": "brand_check", "branded": "brand_check"}
DEFAULT_TYPE = "custom"
# White space as text normalisation knows it, for Java patterns.
SPACE = r"(?U)[\s\x1C-\x1F]+"


def host(url: Column) -> Column:
    """Host of a URL in lower case, with www."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def belongs(url: Column, domain: Column) -> Column:
    """Whether a URL lies on a domain or below it; dots at the end do not count, and what is no URL lies nowhere."""
    h, d = (F.rtrim(c, F.lit(".")) for c in (host(url), F.lower(domain)))
    return F.coalesce((h == d) | h.endswith(F.concat(F.lit("."), d)), F.lit(False))


def bare_domain(raw: Column) -> Column:
    """The domain in what a user typed, without scheme, port and path; null where it holds user data or is no domain."""
    d = F.regexp_extract(F.trim(raw), r"^(?:https://)?(?:http://)?([^/:]*)", 1)
    return F.when(~F.contains(F.regexp_extract(F.trim(raw), r"^(?:https://)?(?:http://)?([^/]*)", 1), F.lit("@")) & d.rlike(r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"), d)


def composed_array(s: pa.Array, rows: int = 64) -> pa.Array:
    """Strings in NFC, so many rows at a time."""
    parts = (s.slice(lo, rows).to_pylist() for lo in range(0, len(s), rows))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in p], pa.string()) for p in parts)])


def composed(text: Column) -> Column:
    """Unicode NFC; only rows with letters beyond ASCII go through Python, in Arrow batches of which few rows at a time are Python strings."""

    @F.arrow_udf("string")
    def nfc(s: pa.Array) -> pa.Array:
        return composed_array(s)

    return F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normal_text(text: Column) -> Column:
    """Text trimmed, in NFC, runs of white space made one space."""
    edge = SPACE.removeprefix("(?U)")
    s = F.regexp_replace(text, rf"(?U)^{edge}|{edge}$", "")
    return F.regexp_replace(composed(s), SPACE, " ")


def mention_key(name: Column) -> Column:
    """Key under which mentions of an entity are counted: lower case, trimmed, no dots and commas, one kind of dash."""
    return F.regexp_replace(F.translate(F.trim(F.lower(name)), ".,", ""), N.DASHES, "-")


def unquoted(name: Column) -> Column:
    """Lower case, trimmed, without quotes around."""
    return F.btrim(F.trim(F.lower(name)), F.lit("«»\"'"))


def aliases(brand: Column) -> Column:
    """Other spellings of a brand: lower case, words of a compound apart, dots and dashes as spaces; none equals the brand. In order, each once."""
    apart = F.regexp_replace(brand, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(brand, r"[.\-_]", " ")
    every = F.array(F.lower(brand), F.when(apart != brand, F.lower(apart)), F.when(spaced != brand, spaced), F.when(spaced != brand, F.lower(spaced)))
    return F.array_distinct(F.filter(every, lambda a: a.isNotNull() & (a != brand)))


def other_script(name: Column) -> Column:
    """The name in the other script, if it is written in one script only and that changes it; else null."""
    low = F.lower(name)
    cyr, lat = low.rlike("[а-яё]"), low.rlike("[a-z]")
    other = F.when(cyr & ~lat, N.latin(name)).when(lat & ~cyr, N.cyrillic(name))
    return F.nullif(other, low)


def query_type(subtype: Column, query_class: Column, by_subtype: Mapping[str, str] = TYPE_OF_SUBTYPE, by_class: Mapping[str, str] = TYPE_OF_CLASS, default: str = DEFAULT_TYPE) -> Column:
    """Query type by subtype, else by class, else the default."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return F.coalesce(F.try_element_at(table(by_subtype), subtype), F.try_element_at(table(by_class), query_class), F.lit(default))


def whole_sentences(text: Column) -> Column:
    """Text up to its last full sentence; as it is where it ends in one or holds none."""
    cut = F.regexp_extract(text, rf"(?s)^(.*[{STOPS}])", 1)
    return F.when(text.rlike(rf"[{STOPS}](?U:\s*)\z") | (F.length(cut) < 2), text).otherwise(cut)


def description(text: Column) -> Column:
    """A generated description as one paragraph: headings, labels, marks and quotes go, and so does a sentence that is cut off."""
    label = r"^\*\*[^*]+:\*\*\s*"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~l.startswith("#"))
    bare = F.transform(lines, lambda l: F.trim(F.btrim(F.btrim(F.regexp_replace(l, label, ""), F.lit("*")), F.lit("_"))))
    one = F.array_join(F.filter(bare, lambda l: l != ""), " ")
    for q in ('"', "'", "«»"):
        one = F.btrim(F.trim(one), F.lit(q))
    return whole_sentences(F.trim(one))


def instant(text: Column) -> Column:
    """Time of an HTTP date, an ISO time or an ISO day (UTC where it names no zone); null for anything else."""
    t = F.trim(text)
    http = F.try_to_timestamp(F.when(t.rlike(r"^[A-Za-z]{3}, \d\d [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d (?:GMT|UTC)$"), F.concat(F.substr(t, F.lit(6), F.lit(20)), F.lit(" +0000"))), F.lit("dd MMM yyyy HH:mm:ss Z"))
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:?\d\d)$"), F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2")).when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit("T00:00:00Z")))
    return F.coalesce(http, F.try_to_timestamp(iso))


def freshness_days(dates: Sequence[Column], now: Column) -> Column:
    """Whole days from the latest of the dates to now, at least 0; null where none can be read."""
    seconds = F.unix_micros(now) - F.unix_micros(F.array_max(F.array(*[instant(d) for d in dates])))
    return F.when(seconds > 0, F.floor(seconds / 86_400_000_000)).when(seconds.isNotNull(), 0).cast("long")


def profile_text(name: Column, *rest: Column) -> Column:
    """Text of a profile for embedding: its parts that are not empty."""
    return F.concat_ws(" | ", name, *[F.nullif(c, F.lit("")) for c in rest])


def text_mark(text: Column) -> Column:
    """Short digest by which a stored embedding is known to be stale."""
    return F.left(F.sha2(text, 256), F.lit(16))


def looked_up(name: Column, known: Sequence[str]) -> Column:
    """The known name that equals a name, else the first that holds it or is held by it, else null; known is a project's own list."""
    n = unquoted(name)
    pairs = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(k).alias("v")) for k in known])
    hit = lambda f: F.try_element_at(F.filter(pairs, f), F.lit(1))["v"]
    return F.coalesce(hit(lambda p: p["k"] == n), hit(lambda p: F.contains(p["k"], n) | F.contains(n, p["k"])))
