"""Every query of the library with SQL against DuckDB over the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from sightline.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in ORACLES:
        assert name in {"name_pairs", "name_links", "name_clusters", "canonical_pick", "vector_clusters", "near_dup", "fuzzy_mentions", "extracted_mentions", "discovered_entities"}  # held against brute force in test_entities.py, test_vectors.py and test_resolve.py
        return
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in got.fetchall()]
    assert Counter(map(str, rows)) == Counter(map(str, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
