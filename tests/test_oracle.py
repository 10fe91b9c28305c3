"""Each query against its SQL over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from scenespark.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))

    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
