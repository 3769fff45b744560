"""Every registered query that has SQL gives DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from fieldweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    spark.catalog.clearCache()
    r = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in r.description]
    want = rows(names, r.fetchall())
    assert sorted(names) == sorted(df.columns) and len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-6, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else a[1:] == b[1:] or a == pytest.approx(b, rel=1e-6)


@pytest.mark.parametrize("name", ["peaks", "spectrum_report"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_peaks_are_found(spark, name, sf):
    assert 8 in [r.f for r in catalog.queries()[name](spark, f"/root/testdata/{sf}").collect()]  # the tide


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["f", "freq", "power"] and df.count() == 13


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
