"""Brands in answers against the rules in plain Python."""

import re
import time
from collections import Counter, defaultdict
from functools import lru_cache

from pyspark.sql import functions as F

from sightline.operators.resolve import _windows, match_extracted, resolve
from sightline.plans import resolve as P
from tests.test_entities import lat, match, skel, sounds_alike

EDGE = "а-яА-ЯёЁa-zA-Z0-9"
same = lru_cache(None)(match)
sound = lru_cache(None)(sounds_alike)


def find(text, name, bounded):
    m = re.search(rf"(?<![{EDGE}]){re.escape(name)}(?![{EDGE}])" if bounded else re.escape(name), text, re.I)
    return m.start() if m else -1


def brute_one(text, names):
    """(step, aliases, at) of one brand, or None."""
    text = text or ""
    got = [(n, find(text, n, True)) for n in names if n and find(text, n, True) >= 0]
    if got:
        return "exact", [n for n, _ in got], min(at for _, at in got)
    words = [w for w in re.findall(r"[a-zA-Zа-яА-ЯёЁ][a-zA-Zа-яА-ЯёЁ0-9]*", text) if len(w) >= 3]
    got = [w for w in words if any(n and len(n) >= 3 and sound(w.lower(), n) for n in names)]
    if got:
        return "sound", got, min(find(text, w, False) for w in got)
    got = [w for w in words if any(n and 3 <= len(n) <= 6 and same(w.lower(), n) for n in names)][:1]
    return ("short", got, find(text, got[0], False)) if got else None


def brute(answers, names):
    brands = defaultdict(dict)
    for project, brand, role, _, n, name in names:
        brands[project].setdefault(brand, (role, {}))[1].setdefault(n, name)
    out = {}
    for i, project, text, prompt in answers:
        for brand, (_, own) in brands[project].items():
            own = [own[k] for k in sorted(own)]
            got = brute_one(text, own)
            if got and not any(n and n.lower() in (prompt or "").lower() for n in own):
                out[i, brand] = got
    return out


def brute_extracted(answers, entities, names):
    brands = defaultdict(dict)
    for project, brand, role, order, _, name in sorted(names, key=lambda r: (r[3], r[1])):
        brands[project].setdefault(brand, (role, []))[1].append(name)
    of = defaultdict(list)
    for i, position, name in sorted(entities):
        of[i].append((position, name))
    mentions, new = {}, []
    for i, project, text, prompt in answers:
        low, in_latin = (prompt or "").lower(), lat(prompt or "")
        held = {b for b, (_, own) in brands[project].items() if prompt and any(n.lower() in low or lat(n) in in_latin for n in own)}
        for position, name in of[i]:
            fits = [b for b, (_, own) in brands[project].items() if any(same(name, n) for n in own)]
            free = [b for b in fits if b not in held and (i, b) not in mentions]
            if free:
                mentions[i, free[0]] = (name, find(text or "", name, False))
            elif not any(brands[project][b][0] == "target" for b in fits):
                new.append((i, position, name))
    return mentions, new


def frames(spark, answers, names):
    a = spark.createDataFrame([(*r, 1) for r in answers], "answer_id long, project int, text string, prompt string, brand int")
    return a, spark.createDataFrame(names, "project int, brand string, role string, ord int, n int, name string")


NAMES = [
    (1, "Winline", "target", 0, 0, "Winline"), (1, "Winline", "target", 0, 1, "WL Bet"), (1, "Пари", "competitor", 1, 0, "Пари"), (1, "C++ Shop", "competitor", 2, 0, "C++"), (1, "Nestlé", "competitor", 3, 0, "Nestlé"),
    (1, "Marathonbet", "competitor", 4, 0, "Marathonbet"), (1, "Marathonbet", "competitor", 4, 1, "Marathonbet"), (1, "日本", "competitor", 5, 0, "日本"), (1, "none", "competitor", 6, 0, ""), (1, "none", "competitor", 6, 1, None), (2, "Winline", "target", 0, 0, "Other"),
]
TEXTS = [
    "Winline is recommended.", "winline, WINLINE and wl bet", "Xwinline winlines", "Винлайн лучше. Винлайн!", "Париматч", "C++ is it, C++", "aC++ C++b", "nestlé", "Nestléx", "Марафонбет и Винлайн", "日本 is far", "", None, "WL  Bet wl-bet", "a b",
    "see wl bet. then Winline", "Пари Париматч", "МАРАФОНБЕТ", "ＷＩＮＬＩＮＥ", "x" * 700 + " winline " + "y" * 700,
]


def test_cases(spark):
    answers = [(i, 1, t, None) for i, t in enumerate(TEXTS)] + [(100, 1, "Winline and C++", "is WINLINE good"), (101, 1, "Winline", "what about wl bet?"), (102, None, "Winline", None), (103, 3, "Winline", None), (104, 2, "Winline other", None)]
    names = [n for n in NAMES if n[5]]
    got = resolve(*frames(spark, answers, NAMES)).collect()
    assert {(r["answer_id"], r["brand"]): (r["step"], r["aliases"], r["at"]) for r in got} == brute(answers, names) and len(got) == len(brute(answers, names))
    steps = Counter(r["step"] for r in got)
    assert steps["exact"] > 5 and steps["sound"] > 2 and steps["short"] > 0
    by = {(r["answer_id"], r["brand"]): r for r in got}
    assert by[0, "Winline"]["is_recommended"] and by[0, "Winline"]["role"] == "target" and by[3, "Winline"]["aliases"] == ["Винлайн", "Винлайн"]
    assert by[len(TEXTS) - 1, "Winline"]["context"].count("x") == 499 and by[15, "Winline"]["sentence"] == 0 and by[15, "Winline"]["aliases"] == ["Winline", "WL Bet"]
    empty = spark.createDataFrame([], "project int, brand string, role string, ord int, n int, name string")
    assert resolve(frames(spark, answers, NAMES)[0], empty).collect() == []
    assert resolve(frames(spark, answers, NAMES)[0].where("false"), frames(spark, answers, NAMES)[1]).collect() == []


def test_exact_step_alone(spark):
    answers = [(i, 1, t, None) for i, t in enumerate(TEXTS)]
    key = lambda d: sorted(map(str, d.where("step = 'exact'").collect()))
    assert key(resolve(*frames(spark, answers, NAMES), near_steps=False)) == key(resolve(*frames(spark, answers, NAMES)))


def test_windows_of_a_long_text(spark):
    """Windows take time in proportion to the text: 10,000 words, which took 2 * 10^8 patterns before."""
    text = "! " + " ".join(f"w{i}" for i in range(10_000))
    d = spark.createDataFrame([(text,), ("",), ("?",), ("a",), ("a b",), ("-a-b",)], "text string").select(_windows(F.col("text"), F.array(F.lit(1), F.lit(2))).alias("w"))
    start = time.time()
    got = [r["w"] for r in d.collect()]
    assert time.time() - start < 10 and len(got[0]) == 19_999 and got[1:] == [[], [], ["a"], ["a", "b", "a b"], ["a", "b", "a-b"]]


def test_extracted_cases(spark):
    answers = [(1, 1, "Winline then Винлайн, Марафонбет", ""), (2, 1, "Winline", "о Winline"), (3, 1, "x", "марафонбет?"), (4, 1, None, None)]
    entities = [(1, 0, "Винлайн"), (1, 1, "Winline"), (1, 2, "Марафонбет"), (1, 3, "Marathonbet"), (1, 4, "Fresh"), (1, 5, None), (1, 6, ""), (2, 0, "winline"), (2, 1, "ООО Пари"), (3, 0, "Marathonbet"), (4, 7, "WL Bet"), (9, 0, "Winline")]
    a, n = frames(spark, answers, NAMES)
    mentions, new = match_extracted(a, spark.createDataFrame(entities, "answer_id long, position int, name string"), n)
    want = brute_extracted(answers, [e for e in entities if e[2]], [x for x in NAMES if x[5]])
    assert {(r["answer_id"], r["brand"]): (r["entity"], r["at"]) for r in mentions.collect()} == want[0]
    assert sorted(tuple(r) for r in new.collect()) == sorted(want[1])
    assert want[0][1, "Winline"] == ("Винлайн", 13) and (1, 4, "Fresh") in want[1] and (2, "Winline") not in want[0] and (2, 0, "winline") not in want[1]
    # a second entity of a competitor goes to no brand, and is new as it does not match the target
    assert (1, 3, "Marathonbet") in want[1]


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_queries(spark, sf_dir):
    answers = rows(P.named_answers(spark, sf_dir), "answer_id", "project", "text", "prompt")
    names = rows(P.brand_names(spark, sf_dir), "project", "brand", "role", "ord", "n", "name")
    want = brute(answers, names)
    got = rows(P.fuzzy_mentions(spark, sf_dir), "answer_id", "brand", "step", "aliases", "at")
    assert {(i, b): (s, a.split("|"), at) for i, b, s, a, at in got} == {k: v for k, v in want.items() if v[0] != "exact"}
    assert {s for _, _, s, _, _ in got} == {"sound", "short"}
    entities = rows(P.extracted(spark, sf_dir), "answer_id", "position", "name")
    mentions, new = brute_extracted(answers, entities, names)
    got = rows(P.extracted_mentions(spark, sf_dir), "answer_id", "brand", "entity", "at")
    assert {(i, b): (e, at) for i, b, e, at in got} == mentions and len(got) == len(mentions)
    project = {a[0]: a[1] for a in answers}
    count = Counter((project[i], n) for i, _, n in new)
    assert {(r[0], r[1]): r[2] for r in rows(P.discovered_entities(spark, sf_dir), "project", "name", "mentions")} == count and count


def test_skeletons():
    assert skel("Winline") == skel("Винлайн") and not sounds_alike("Winline", "Vinlain")
