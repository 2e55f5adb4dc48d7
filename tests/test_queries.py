"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    df = df.astype({c: float for c in df.columns if df[c].dtype.kind in "iu"})
    return sorted(tuple("none" if v is None or v != v else repr(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got = QUERIES[name](spark, D).toPandas()
    assert len(got)
    if name in ORACLES:
        want = db.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
