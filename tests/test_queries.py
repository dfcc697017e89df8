"""Every registered query against DuckDB on the small tables."""

import os

import pandas as pd
import pytest

from tidemark import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def text(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    mine, theirs = registry.QUERIES[name](spark, DIR).toPandas(), duck.sql(registry.ORACLE[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    table = lambda df: sorted(tuple(map(text, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert table(mine) == table(theirs)
