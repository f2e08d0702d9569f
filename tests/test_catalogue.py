"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

from strandline.plans import catalogue

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def shown(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*names).collect())
    cur = duck.execute(catalogue.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == names
    assert got == sorted(tuple(shown(r[at[n]]) for n in names) for r in cur.fetchall())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "search_page_1" in entry.queries()
