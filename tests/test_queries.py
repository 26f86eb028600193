"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from emberline.plans.all import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canon(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(round(v, 9))
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
