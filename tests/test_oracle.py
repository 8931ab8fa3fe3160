"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from glintfield.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr(r) for r in frame[names].astype(object).where(frame[names].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalogue.ORACLE_SQL[name]).df())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["chip", "r", "c", "red", "green", "blue"]
