"""Every registered query against its SQL, on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import catalog

DATA = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df):
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    columns = sorted(df.columns)
    return columns, sorted((tuple(cell(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name in catalog.oracle_sql():
        assert rows(got) == rows(duck.execute(catalog.oracle_sql()[name]).df())
    else:
        assert len(got) > 0
