"""Every query with SQL gives the rows that DuckDB gives for it."""

import decimal

import duckdb
import pytest

from placewright import plans

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names: list[str], values: list) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([float(r[i]) if isinstance(r[i], decimal.Decimal) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, db, name):
    want = db.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
