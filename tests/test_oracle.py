"""Every query of the engine against its SQL twin on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from preflux.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    ran = db.execute(registry.ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == order
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in ran.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
