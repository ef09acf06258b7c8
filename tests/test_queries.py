import os

import duckdb
import pytest

from tablesmith.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    assert len(got) or sql
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())
