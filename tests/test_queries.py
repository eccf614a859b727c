"""Every registered query of the library against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from recallspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name in registry.ORACLES:
        result = db.execute(registry.ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows([tuple(r) for r in got], df.columns) == rows(result.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
