"""Every query over the standard tables gives the rows of its SQL, at the smallest scale."""

import math
import os

import pytest

from spoolkit.plans import catalog, harvested, recorded  # noqa: F401  (registers its queries with those of the catalog)

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: ("nan" if math.isnan(x) else repr(round(x, 6) + 0.0)) if isinstance(x, float) else str(x)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SF)
    found = tables.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), columns)
