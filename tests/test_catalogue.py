"""Every query of the catalogue against its SQL on the driver's smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def _rows(df):
    def plain(x):
        if x is None or x != x:
            return "~"
        return round(float(x), 9) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f" else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_queries(spark, duck):
    from ontoweave.plans.catalogue import QUERIES, SQL

    for name, run in QUERIES.items():
        got = run(spark, SF).toPandas()
        assert len(got) or name in SQL, name  # a page beyond the smallest table is empty
        if name in SQL:
            want = duck.execute(SQL[name]).df()
            assert sorted(got.columns) == sorted(want.columns), name
            assert _rows(got) == _rows(want), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
