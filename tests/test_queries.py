"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import pytest

from gridcover.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(names, got):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return round(v, 9) if isinstance(v, float) else str(v) if not isinstance(v, bool) else v

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cur = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_known_histograms(spark):
    """The counts that FIXTURES.md gives for these tables."""
    q = registry.queries()
    assert {r["level"]: r["cell_count"] for r in q["leaf_level_histogram"](spark, SF).collect()} == {1: 15, 2: 2, 9: 1, 11: 3, 12: 45}
    assert {r["level"]: r["n"] for r in q["lookup_level_histogram"](spark, SF).collect()} == {1: 191, 2: 159, 9: 13, 10: 12, 11: 58, 12: 567}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1000
    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
