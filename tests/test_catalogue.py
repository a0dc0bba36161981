"""Every query of the catalogue runs, and equals its SQL in DuckDB."""

import os

import duckdb
import pytest

from binloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return cols, sorted(([plain(v) for v in r] for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.sql(sql).df())
    else:
        assert len(got)


def test_entry_without_and_with_the_optional_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
