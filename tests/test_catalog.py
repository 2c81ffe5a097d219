"""Columns and lists of projects on small cases."""

import unicodedata

from pyspark.sql import functions as F

from sightline.functions import catalog as C
from sightline.operators import catalog as O


def values(spark, column, rows):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[1] for r in sorted(d.select("i", column(F.col("s"))).collect())]


def test_normal_text(spark):
    rows = ["  ä  b\n\tc ", "", " x y", "plain", None]
    want = ["ä b c", "", "x y", "plain", None]
    assert values(spark, C.normal_text, rows) == [w and unicodedata.normalize("NFC", w) for w in want]


def test_domains(spark):
    assert values(spark, C.bare_domain, ["https://Shop.Example.com:80/x", "u@shop.com", "shop", "http://a.b.co", "-a.com", "", None]) == ["Shop.Example.com", None, None, "a.b.co", None, None, None]
    inside = lambda u: C.belongs(u, F.lit("example.com"))
    assert values(spark, inside, ["https://example.com/", "https://a.example.com.", "https://aexample.com", "nothing", "", None]) == [True, True, False, False, False, False]


def test_names(spark):
    assert values(spark, C.aliases, ["SEMrush", "Яндекс.Метрика", "plain"]) == [["semrush"], ["яндекс.метрика", "Яндекс Метрика", "яндекс метрика"], []]
    assert values(spark, C.aliases, ["superShop"]) == [["supershop", "super shop"]]
    assert values(spark, C.mention_key, [" A.B, Inc — x ", "", None]) == ["ab inc - x", "", None]
    assert values(spark, C.unquoted, ["«Имя»", ' "x" ', "it's"]) == ["имя", "x", "it's"]
    assert values(spark, C.other_script, ["Москва", "Ahrefs МС", "123"]) == ["moskva", None, None]


def test_texts(spark):
    assert values(spark, C.whole_sentences, ["One. Two", "One. ", "none", "", ".x"]) == ["One.", "One. ", "none", "", ".x"]
    assert values(spark, C.description, ["## T\n**Label:**\n**L:** *Good* tool. And mo", "«Quoted one.»"]) == ["Good* tool.", "Quoted one."]


def test_freshness(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    days = lambda s: C.freshness_days([s, F.lit(None).cast("string")], now)
    rows = ["Mon, 01 Jan 2024 00:00:00 GMT", "2024-01-09", "2024-01-08T12:00:00+0000", "2024-01-08T12:00:00.5+00:00", "2030-01-01", "soon", None]
    assert values(spark, days, rows) == [9, 1, 1, 1, 0, None, None]


def test_scenario_tree(spark):
    s = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "gone"), (1, "d", "b"), (2, "a", "")], "project_id int, name string, parent string")
    q = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, None), (1, "")], "project_id int, category string")
    got = {(r["project_id"], r["name"]): (r["parent"], r["prompt_count"], [tuple(c) for c in r["children"]], r["uncategorized"]) for r in O.scenario_tree(s, q).collect()}
    assert got == {(1, "a"): (None, 1, [("b", 2)], 2), (1, "c"): ("gone", 0, [], 2), (1, "d"): ("b", 0, [], 2), (2, "a"): (None, 0, [], 0)}


def test_suggestions_and_lookup(spark):
    c = spark.createDataFrame([(1, n, i) for i, n in enumerate("ABCD")], "project_id int, name string, rank int")
    t = spark.createDataFrame([(1, "b")], "project_id int, name string")
    assert [r["name"] for r in O.suggestions(c, t, 2).orderBy("place").collect()] == ["A", "C"]
    known = lambda s: C.looked_up(s, ["Acme Group", "Acme"])
    assert values(spark, known, ["acme", "«Acme»", "acme gr", "x", None]) == ["Acme", "Acme", "Acme Group", None, None]


def test_scope_by_equal_category(spark):
    """A category binds by equality where one is given, and the query of the metrics is of all categories."""
    rows = [("t0", 2, "1998-06-01", "A-F", c) for c in ("ECONOMY", "ECO", "PROMO", "", None)]
    d = spark.createDataFrame(rows, "tenant string, project_id int, day string, provider string, category string").withColumn("day", F.col("day").cast("date"))
    assert O.scope(d, project_id=2, asof="1998-06-30", days=365, category="ECO", tenant="t0").count() == 1 and O.scope(d, project_id=2, tenant="t0").count() == 5


def test_scoped_metrics_of_all_categories(spark, sf_dir):
    from sightline.plans.catalog import ASOF, scoped_metrics
    from sightline.sources.adapters import joined

    d = joined(spark, sf_dir).where("project_id = 2 and provider in ('A-F', 'N-O')").where(F.col("day").between(F.date_sub(F.lit(ASOF).cast("date"), 365), F.lit(ASOF).cast("date")))
    assert {r["provider"]: r["checks"] for r in scoped_metrics(spark, sf_dir).collect()} == {r["provider"]: r["count"] for r in d.groupBy("provider").count().collect()}
    assert d.where("category is null or category = ''").count() > 0


def test_composed_by_rows():
    """Null, empty and decomposed strings in an Arrow array that is longer than what is taken at once, one that is a slice, and none."""
    import pyarrow as pa

    from sightline.functions.catalog import composed_array

    a = pa.array([None, "", "a\u0308", "\u0435\u0308x", "plain"] * 50)
    want = [None, "", "\u00e4", "\u0451x", "plain"] * 50
    assert composed_array(a).to_pylist() == want and composed_array(a.slice(7), 3).to_pylist() == want[7:] and composed_array(a.slice(0, 0)).to_pylist() == []
