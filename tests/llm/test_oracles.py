import duckdb
import pandas as pd
import pytest

from loomgraph.llm.oracles import ORACLES
from loomgraph.llm.queries import QUERIES


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    plain = lambda v: "none" if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) else v
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, d).toPandas()
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
