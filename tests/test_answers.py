"""Answer analysis: plain searches in front of patterns lose nothing, and queries pay for the steps that they use."""

import random

from pyspark.sql import functions as F

from sightline.functions import text as T
from sightline.operators.answers import analyze

PARTS = [
    "I am an AI", "i'm a language model", "I am an aı", "conſult a doctor", "Я ИИ", "я \u1c82скусственный", "не даю  медицинских", "not legal ADVICE", "cannot provide legal", "обратитесь к врачу",
    "best", "Best", "bests", "лучший", "проблема", "slow", "ｓlow", "ſlow", "K", "Цена", "prıcing", "pricing", "FEATURE", "ea\u017fe", "user friendly", "быстро", "API", "apı",
    "Brand#1", "BRAND#1", "brand#12", "xBrand#1", "яBrand#1", " ", "\n", ". ", "é",
]


def test_searches_lose_nothing(spark):
    rng = random.Random(5)
    texts = PARTS + ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)] + [None, ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    seen = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[а-яА-ЯёЁa-zA-Z]+"), F.lit(0)))
    good, bad = (F.size(F.array_intersect(seen, F.array(*map(F.lit, w)))) for w in (T.GOOD, T.BAD))
    score = F.coalesce(F.round(F.try_divide((good - bad).cast("double"), (good + bad).cast("double")), 2), F.lit(0.0))
    tags = F.array_compact(F.array(*[F.when(t.rlike("(?iu)" + p), k) for k, p in T.TAGS.items()]))
    at = lambda n: (F.regexp_instr(t, F.lit(rf"(?iu)(?<![{T.EDGE}])\Q{n}\E(?![{T.EDGE}])")) - 1).cast("long")
    for got, want in ((T.lexicon_score(t), score), (T.tags(t), tags), (T.offset(t, F.lit("brand#1")), at("brand#1")), (T.offset(t, F.lit("slow")), at("slow")), (T.offset(t, F.lit("é")), at("é"))):
        assert d.where(~got.eqNullSafe(want)).collect() == []
    for p, words in T.REFUSALS.items():
        may = T.bind(T.folded(t), lambda x: T.holds(x, words))  # noqa: B023
        assert d.where(t.rlike("(?iu)" + p) & ~may).collect() == []


def test_steps_are_apart(spark):
    d = analyze(spark.range(3).selectExpr("id", "concat('1. Acme', id) AS text"), F.lit("Acme"))
    plan = lambda *c: d.select(*c)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan("items") and "regexp_extract_all" not in plan("flag", "clean")
