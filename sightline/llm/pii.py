"""Personal data and secrets by weak supervision, as DataFrame expressions only.

Base spans come from four patterns and their checks. Candidates of further kinds come from looser patterns, which by design also find much
that is no personal data (order numbers, hashes of commits, section numbers). Regex, arithmetic, gazetteer and context labelers vote on every
candidate, failed base matches included; expectation-maximisation estimates how reliable each labeler is, and a logistic span
classifier is trained on the resulting soft labels. Candidates of the further kinds that it accepts and that touch no base span are added; base spans
always stay. No labeler counts as worse than chance: a vote against never raises the odds, in the EM and in the classifier.

What is trained is a table of vote patterns and their counts over all documents: at most len(KINDS) * 3 ** len(LABELERS)
rows whatever the corpus holds, so the few sums of the EM run on the driver. Everything else stays in Spark expressions.

Defined results: a null text is an empty text, without spans. Rows are judged alone (repeated rows get equal results) and
no join is made, so null or repeated ids are kept as they are. Offsets are code points, end exclusive. Patterns never restart inside a run that has
already failed, offsets are running sums in blocks of blocks, and contexts are cut from the gaps between matches (the words before a
candidate reach back to the one before it of its kind at most), so a text of any length and of any number of matches takes time in proportion to it,
but for the sorting of its spans. Columns beside the text are passed through; the operator's own columns replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns (same matches as their plain forms; the look-behinds skip starts that cannot match).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Names of secrets in English, German, French and Spanish.
SECRET_NAMES = "api[_-]?key|access[_-]?key|secret|token|passwor[dt]|passwd|pwd|bearer|schlüssel|kennwort|mot de passe|mdp|jeton|contraseña|clave"
MORE = {
    "hidden_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|ät|arobase|arroba)[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|punkt|point|punto)[)\]]) ?[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9.+-])[0-9]{8,12}(?![A-Za-z0-9-])",
    "secret": rf"(?<![\p{{L}}0-9_])(?i:{SECRET_NAMES})[\"']? ?(?:=>|[:=]) ?[\"']?[^\s\"',;]{{6,}}+[\"']?|(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{{20,}}+={{0,2}}",
    "person": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|M|Mme|Mlle|Sr|Sra|Don|Doña)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?(?![\p{L}])",
}
KINDS = (*BASE, *MORE)

# Gazetteers.
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ru|it|nl|pl|br|ch|at|us|ca|au|jp|cn|in"
DIAL_CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|37[0-9]|38[0-9]|42[013]"
IBAN_COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE"
KEY_PREFIXES = "AKIA|ASIA|ghp_|gho_|glpat-|sk[-_]|pk_|xox[abp]-|eyJ|AIza"
GIVEN_NAMES = (
    "Anna|Maria|Marie|John|James|Peter|Paul|Michael|Thomas|David|Robert|Laura|Julia|Sarah|Emma|Mary|William|Luis|José|Jose|Carlos|Carmen|Ana|Lucía|Javier|Pierre|Jean|"
    "Sophie|Claire|Louis|Hans|Klaus|Karl|Jürgen|Sabine|Ursula|Ivan|Olga"
)

# Words before a span that speak for it, by what they ask for, in English, German, French and Spanish.
MAIL_WORDS = "e-?mail|mail|contact|reach|write to|kontakt|schreib\\w*|courriel|écri\\w*|correo|escrib\\w*"
CALL_WORDS = "tel|telephone|phone|call|fax|mobile|telefon|handy|ruf\\w*|anruf\\w*|téléphone|appel\\w*|portable|teléfono|móvil|llam\\w*"
BANK_WORDS = "card|visa|mastercard|iban|account|bank|karte|konto\\w*|kreditkarte|carte|compte|tarjeta|cuenta"
ID_WORDS = "ssn|social security|passport|national id|identity|ausweis\\w*|sozialversicherung\\w*|passeport|identité|sécurité sociale|pasaporte|dni"
HOST_WORDS = "ip|address|host|server|client|adresse|rechner|serveur|hôte|servidor|dirección"
NAME_WORDS = "name|dear|by|from|called|namens|liebe[r]?|von|nom|cher|chère|par|nombre|querid[oa]|por|de"
SECRET_WORDS = SECRET_NAMES + "|key|credentials?|login|zugang\\w*|identifiants?|credencial\\w*"
# Words that speak against.
AGAINST_WORDS = (
    "version|release|isbn|issn|doi|order|invoice|total|price|page|pages|figure|table|section|chapter|no|nr|ref|commit|revision|sha-?(?:1|256)?|md5|checksum|hash|digest|uuid|seite|abbildung|"
    "tabelle|abschnitt|kapitel|rechnung|bestellung|preis|commande|facture|prix|chapitre|tableau|página|pedido|factura|precio|capítulo|tabla"
)

LABELERS = ("shape", "arithmetic", "gazetteer", "own_context", "any_context", "counter_context", "flank")


@dataclass(frozen=True)
class PiiModel:
    """log-odds: bias, kind -> weight, (labeler, vote) -> weight; and the EM's reliability of each labeler: how often its votes are right."""

    bias: float
    kinds: dict
    votes: dict
    reliability: dict


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and in whatever lambda body uses it."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, start: Column, op: Callable[[Column, Column], Column], block: int = 64, levels: int = 2) -> Column:
    """op over the elements before each element, start for the first: in blocks, and blocks of blocks, so that no array is grown or read whole for each element."""
    fold = lambda a: F.aggregate(a, start, op)
    if not levels:
        return F.transform(values, lambda _, i: fold(F.slice(values, F.lit(1), i)))

    def in_blocks(blocks: Column) -> Column:
        sums = let(F.transform(blocks, fold), lambda s: scan(s, start, op, block, levels - 1))
        return let(
            sums,
            lambda before: F.flatten(
                F.transform(blocks, lambda part, b: let(F.get(before, b), lambda first: F.transform(part, lambda _, i: op(first, fold(F.slice(part, F.lit(1), i))))))
            ),
        )

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(F.transform(starts, lambda b: F.slice(values, b * block + 1, F.lit(block))), in_blocks))


def _digits(x: Column) -> Column:
    return F.length(x) - F.length(F.regexp_replace(x, "[0-9]+", ""))


def _luhn(x: Column) -> Column:
    d = F.reverse(F.filter(F.split(x, ""), lambda c: c.rlike("[0-9]")))
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    s = F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, v: a + v)
    return s % 10 == 0


def _mod97(x: Column) -> Column:
    """Whether an IBAN's check digits hold."""
    bare = F.replace(x, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    value = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(_digits(x).between(16, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return _digits(x).between(8, 15)
    return F.lit(True)


# Necessary conditions of the kinds, each beginning with one class of characters, so that plain text is passed over quickly.
GUARDS = {
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9]",
    "hidden_email": r"[(\[](?:at|ät|arobase|arroba)[)\]]",
    "iban": r"[A-Z][A-Z][0-9][0-9] ?[A-Z0-9]{4}",
    "local_phone": r"[0-9]\)?[ .-][0-9]{3,4}[ .-][0-9]{3}",
    "national_id": r"[0-9]-[0-9][0-9]-[0-9]{4}",
    "account": r"[0-9]{8}",
    "person": r"[DFHMPS](?:(?<=D)(?:r|on|oña)|(?<=F)rau|(?<=H)errn?|(?<=M)(?:rs?|s|me|lle)?|(?<=P)rof|(?<=S)ra?)\.? \p{Lu}",
}


def _guard(kind: str, t: Column) -> Column:
    """A cheap necessary condition; the pattern runs over the text only where it holds."""
    if kind == "email":
        return t.contains("@")
    if kind == "phone":
        return t.contains("+")
    if kind == "secret":  # names from the sign behind them; a run of 20 with a digit has 10 characters on one side of it
        named = (t.contains("=") | t.contains(":")) & t.rlike(rf"[:=](?<=(?i:{SECRET_NAMES})[\"']? ?[:=])")
        return named | t.rlike("[0-9](?:[A-Za-z0-9_+/-]{10}|(?<=[A-Za-z0-9_+/-]{11}))")
    return t.rlike(GUARDS[kind])


def _found(kind: str, t: Column) -> Column:
    """(kind, m, gaps): all matches of a kind's pattern, and the text between them."""
    pattern = (BASE | MORE)[kind]
    none = F.array().cast("array<string>")
    matches = F.when(_guard(kind, t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
    return let(matches, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.when(F.size(m) > 0, F.split(t, pattern, -1)).otherwise(none).alias("gaps")))


def _placed(found: Column) -> Column:
    """Array of (kind, s, e, x, the 40 characters before, the one after, whether the kind's check holds)."""
    kind, m, gaps = found["kind"], found["m"], found["gaps"]
    zero = F.lit(0).cast("long")

    def span(x: Column, gap: Column, behind: Column, before: Column) -> Column:
        ok = F.lit(True)
        for k in BASE:
            ok = F.when(kind == k, _valid(k, x)).otherwise(ok)
        s = before + F.length(gap)
        fields = {"kind": kind, "s": s, "e": s + F.length(x), "x": x, "before": F.right(gap, F.lit(40)), "after": F.left(behind, F.lit(1)), "ok": ok}
        return F.struct(*[v.alias(name) for name, v in fields.items()])

    sizes = F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(gaps, i))).cast("long"))
    begins = let(sizes, lambda z: scan(z, zero, lambda a, b: a + b))
    return let(begins, lambda at: F.transform(m, lambda x, i: span(x, F.get(gaps, i), F.get(gaps, i + 1), F.get(at, i))))


def _spans(df: DataFrame) -> DataFrame:
    """df with _p_found: array of all kinds' matches."""
    t = F.col("_p_text")
    every = F.filter(F.array(*[_found(k, t) for k in KINDS]), lambda q: F.size(q["m"]) > 0)
    # a one-row explode: what is above reads the spans and is not merged with what finds them
    row = F.explode(F.array(F.struct(F.flatten(F.transform(every, _placed)).alias("found")))).alias("_p_row")
    return df.select("*", row).select("*", F.col("_p_row.found").alias("_p_found")).drop("_p_row")


def _of(kind: str, spans: str | Column) -> Column:
    return F.filter(spans, lambda y: y["kind"] == kind)


def _votes(y: Column) -> list[Column]:
    """One vote (-1, 0, 1) of each labeler on a match."""
    kind, x, before = y["kind"], y["x"], y["before"]
    sign = lambda good, bad=None: F.when(good, 1).when(F.lit(False) if bad is None else bad, -1).otherwise(0)
    near = lambda w: before.rlike(rf"(?i)(?<![\p{{L}}])(?:{w})[^\p{{L}}]{{0,12}}$")
    digits = _digits(x)
    value = F.regexp_replace(x, rf"^(?i:{SECRET_NAMES})[\"']? ?(?:=>|[:=]) ?[\"']?|[\"']$", "")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    shape = (
        F.when(kind.isin("email", "hidden_email"), sign(x.rlike(r"^[A-Za-z0-9][^@]{1,63}$|^[^@]{1,64}@[A-Za-z0-9.-]{3,}$"), F.length(x) > 254))
        .when(kind == "ip", sign(~x.rlike(r"^0|\.0[0-9]"), x.rlike(r"^0\.")))
        .when(kind == "card", sign(x.rlike("^(?:[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4})$"), ~digits.between(13, 19)))
        .when(kind == "phone", sign(digits.between(10, 13), x.rlike(r"\.[0-9]*\.[0-9]*\.[0-9]*\.")))
        .when(kind == "iban", sign(digits >= 10, digits < 6))
        .when(kind == "local_phone", sign(digits.between(10, 11), digits < 9))
        .when(kind == "national_id", sign(~x.rlike("^(?:000|666|9)|-00-|-0000$"), x.rlike("^(?:000|666)|-00-|-0000$")))
        .when(kind == "account", sign(F.lit(False), x.rlike("^(?:19|20)[0-9]{6}$|0000$")))
        .when((kind == "secret") & (~value.rlike("[0-9]") | value.rlike("^[/_-]|://|/[a-z]+[0-9]?/")), -1)
        .when(kind == "secret", sign(mixed & value.rlike("^[A-Za-z0-9_+/=.-]{16,}$")))
        .otherwise(sign(x.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$")))
    )
    arithmetic = (
        F.when(kind == "iban", sign(_mod97(x), ~_mod97(x)))
        .when(kind == "card", sign(y["ok"], ~y["ok"]))
        .when(kind.isin("ip", "phone"), F.when(y["ok"], 1).otherwise(-1))
        .when(kind == "account", sign(F.lit(False), x.rlike(r"^([0-9])\1+$|^0?123456")))
        .when(kind == "secret", let(F.size(F.array_distinct(F.split(value, ""))), lambda n: sign(n >= 11, n <= 6)))
        .otherwise(0)
    )
    gazetteer = (
        F.when(kind.isin("email", "hidden_email"), sign(x.rlike(rf"(?i)[. )\]](?:{TLDS})$"), x.rlike(r"\.[0-9]+$")))
        .when(kind == "phone", sign(x.rlike(rf"^\+(?:{DIAL_CODES})")))
        .when(kind == "card", sign(x.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), x.rlike("^[0189]")))
        .when(kind == "iban", sign(x.rlike(f"^(?:{IBAN_COUNTRIES})"), ~x.rlike("^(?:[A-DF-IK-NPR-TV]|EE|ES|OM|ZA)")))
        .when(kind == "secret", sign(value.rlike(f"^(?:{KEY_PREFIXES})"), value.rlike(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")))
        .when(kind == "person", sign(x.rlike(rf" (?:{GIVEN_NAMES})(?: |$)")))
        .otherwise(0)
    )
    own = (
        F.when(kind.isin("email", "hidden_email"), near(MAIL_WORDS))
        .when(kind.isin("phone", "local_phone"), near(CALL_WORDS))
        .when(kind.isin("card", "iban", "account"), near(BANK_WORDS))
        .when(kind == "national_id", near(ID_WORDS))
        .when(kind == "ip", near(HOST_WORDS))
        .when(kind == "secret", near(SECRET_WORDS) | x.rlike(rf"^(?i:{SECRET_NAMES})"))
        .otherwise(near(NAME_WORDS))
    )
    every = "|".join((MAIL_WORDS, CALL_WORDS, BANK_WORDS, ID_WORDS, HOST_WORDS, NAME_WORDS, SECRET_WORDS))
    flank = F.concat(F.right(before, F.lit(1)), F.lit("\n"), y["after"])
    return [
        shape,
        arithmetic,
        gazetteer,
        sign(own),
        sign(near(every)),
        F.when(before.rlike(rf"(?i)(?<![\p{{L}}])(?:{AGAINST_WORDS})[^\p{{L}}]{{0,6}}$"), -1).otherwise(0),
        F.when(flank.rlike(r"^[#$€£=/_\\]|\n[%/_=]"), -1).otherwise(0),
    ]


def _em(rows: list[tuple], n_l: int, rounds: int) -> tuple[list, list]:
    """(posterior of each vote pattern, theta[labeler][class][vote]); votes of a class are independent, as in Dawid and Skene's model."""
    smooth = 2.0
    post = [1 / (1 + math.exp(-(0.2 + sum(v)))) for _, v, _ in rows]
    theta: list = []
    for _ in range(rounds):
        # a labeler votes for or against, or abstains; pseudo-counts keep the two classes from changing places
        counts = [[{-1: smooth * (3 if y == 0 else 1), 0: smooth * 4, 1: smooth * (3 if y == 1 else 1)} for y in (0, 1)] for _ in range(n_l)]
        mass = [smooth, smooth]
        for (_, v, c), p in zip(rows, post, strict=True):
            for y, q in ((0, 1 - p), (1, p)):
                mass[y] += c * q
                for j in range(n_l):
                    counts[j][y][v[j]] += c * q
        theta = [[{x: k / sum(t.values()) for x, k in t.items()} for t in pair] for pair in counts]
        for no, yes in theta:  # no labeler is worse than chance
            if yes[1] < no[1]:
                yes[1] = no[1] = (yes[1] + no[1]) / 2
            if yes[-1] > no[-1]:
                yes[-1] = no[-1] = (yes[-1] + no[-1]) / 2
            yes[0], no[0] = 1 - yes[1] - yes[-1], 1 - no[1] - no[-1]
        prior = math.log(mass[1] / mass[0])
        odds = [prior + sum(math.log(theta[j][1][v[j]] / theta[j][0][v[j]]) for j in range(n_l)) for _, v, _ in rows]
        post = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return post, theta


def _fit(rows: list[tuple], labelers: tuple = LABELERS, rounds: int = 40, steps: int = 400) -> PiiModel:
    """EM over (kind, votes, count) patterns, then a logistic classifier on the soft labels. Every kind weighs the same in it, however common."""
    n_l = len(labelers)
    post, theta = _em(rows, n_l, rounds)
    right = {}
    for j, name in enumerate(labelers):
        good = sum(c * (p if v[j] == 1 else 1 - p) for (_, v, c), p in zip(rows, post, strict=True) if v[j])
        right[name] = round(good / voted, 4) if (voted := sum(c for _, v, c in rows if v[j])) else None
    of_kind: dict = {}
    for k, _, c in rows:
        of_kind[k] = of_kind.get(k, 0) + c
    names = ["", *[("kind", k) for k in KINDS], *[(j, x) for j in range(n_l) for x in (-1, 1)]]
    w = dict.fromkeys(names, 0.0)
    active = [["", ("kind", k), *[(j, v[j]) for j in range(n_l) if v[j]]] for k, v, _ in rows]
    share = [c / of_kind[k] / len(of_kind) for k, _, c in rows]
    for _ in range(steps):  # gradient steps with a small ridge; features are indicators, so a step of 4 / (features + 1) is safe
        grad = {k: 0.002 * x for k, x in w.items()}
        for f, p, c in zip(active, post, share, strict=True):
            e = c * (1 / (1 + math.exp(-sum(w[k] for k in f))) - p)
            for k in f:
                grad[k] += e
        for k, g in grad.items():
            w[k] -= 4 / (3 + n_l) * g
            if k and k[0] != "kind":
                w[k] = max(0.0, w[k]) if k[1] == 1 else min(0.0, w[k])
    return PiiModel(w[""], {k: w["kind", k] for k in KINDS}, {(j, x): w[j, x] for j in range(n_l) for x in (-1, 1)}, right)


def train(df: DataFrame, text: str = "text") -> PiiModel:
    """The span classifier of a corpus, from the votes on every candidate of every document."""
    found = _spans(df.select(F.coalesce(F.col(text), F.lit("")).alias("_p_text")))
    # runs of a few digits match the card pattern, but nobody would take them for one
    cast = found.select(F.explode("_p_found").alias("y")).where((F.col("y.kind") != "card") | (_digits(F.col("y.x")) >= 13)).select(F.col("y.kind").alias("kind"), F.array(*_votes(F.col("y"))).alias("v"))
    rows = cast.groupBy("kind", "v").count().collect()  # at most len(KINDS) * 3 ** len(LABELERS) rows
    return _fit(sorted((r["kind"], tuple(r["v"]), r["count"]) for r in rows))


def _log_odds(m: PiiModel, y: Column) -> Column:
    out = F.lit(m.bias)
    kind = F.lit(0.0)
    for k in MORE:
        kind = F.when(y["kind"] == k, m.kinds[k]).otherwise(kind)
    for j, v in enumerate(_votes(y)):
        out = out + let(v, partial(_weight, m, j))
    return out + kind


def _weight(m: PiiModel, labeler: int, vote: Column) -> Column:
    return F.when(vote == 1, m.votes[labeler, 1]).when(vote == -1, m.votes[labeler, -1]).otherwise(0.0)


def _free(more: Column, base: Column) -> Column:
    """The spans of more that overlap none of base: in order of start, the furthest end before and the nearest start behind tell."""
    edge = lambda y, is_base: F.struct(y["s"].alias("s"), F.lit(is_base).alias("b"), y["e"].alias("e"), y.alias("y"))
    every = F.array_sort(F.concat(F.transform(base, lambda y: edge(y, 0)), F.transform(more, lambda y: edge(y, 1))))
    far = F.lit(1 << 62)

    def judged(z: Column) -> Column:
        reach = scan(F.transform(z, lambda q: F.when(q["b"] == 0, q["e"]).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        back = F.reverse(F.transform(z, lambda q: F.when(q["b"] == 0, q["s"]).otherwise(far).cast("long")))
        ahead = let(let(back, lambda r: scan(r, far.cast("long"), lambda a, b: F.least(a, b))), F.reverse)
        alone = lambda q, i, a, b: (q["b"] == 1) & (F.get(a, i) <= q["s"]) & (F.get(b, i) >= q["e"])
        return let(reach, lambda a: let(ahead, lambda b: F.transform(F.filter(z, lambda q, i: alone(q, i, a, b)), lambda q: q["y"])))

    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(let(every, judged))


def pii(df: DataFrame, model: PiiModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """df with base_spans and more_spans (arrays of kind, s, e, x by kind and start; the second without overlaps of the first)."""
    own = ("base_spans", "more_spans")
    out = _spans(df.drop(*[c for c in own if c != text]).withColumn("_p_text", F.coalesce(F.col(text), F.lit(""))))
    limit = math.log(threshold / (1 - threshold))
    base = F.concat(*[F.filter(_of(k, "_p_found"), lambda y: y["ok"]) for k in BASE])
    more = F.filter("_p_found", lambda y: y["kind"].isin(*MORE) & (_log_odds(model, y) >= limit))
    got = F.explode(F.array(F.struct(base.alias("base"), more.alias("more")))).alias("_p_row")
    out = out.select(*[c for c in out.columns if c not in ("_p_text", "_p_found")], got)
    slim = lambda a: F.transform(a, lambda y: F.struct(y["kind"].alias("kind"), y["s"].alias("s"), y["e"].alias("e"), y["x"].alias("x")))
    free = let(_free(F.col("_p_row.more"), F.col("_p_row.base")), lambda a: F.concat(*[_of(k, a) for k in MORE]))
    return out.withColumns({"base_spans": slim(F.col("_p_row.base")), "more_spans": slim(free)}).drop("_p_row")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda y: F.concat_ws(":", y["kind"], y["s"], y["e"])), ",")


def op5_pii_weak_supervision(spark, sf_dir: str) -> DataFrame:
    from sightline.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii(docs, train(docs))
    of = lambda k: F.size(_of(k, "base_spans")).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[of(k) for k in BASE], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "more_spans")).alias("spans"),
        F.size(_of("secret", "more_spans")).cast("long").alias("n_secret"),
        (F.size("base_spans") + F.size("more_spans")).cast("long").alias("n_spans"),
    )
