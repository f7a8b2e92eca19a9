"""Every query with SQL gives DuckDB's rows; the others give rows of a stable schema."""

import math
import os

import duckdb
import pandas as pd
import pytest

from inkveil.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def show(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else repr(x.item() if hasattr(x, "item") else x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
