"""Every query with SQL gives the rows that an independent engine gives, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from chronolens.plans import catalog, surface

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = catalog.QUERIES | surface.QUERIES
SQL = catalog.SQL | surface.SQL


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(frame):
    def one(x):
        if x is None or pd.isna(x) is True:
            return "null"
        if isinstance(x, float):
            return f"{x:.5g}" if math.isfinite(x) else str(x)
        return str(x)

    return sorted(tuple(one(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, small, name):
    own, other = ALL[name](spark, small).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert plain(own) == plain(other)


@pytest.mark.parametrize("name", ["all_statistics", "garch_fit", "content_digests", "audit_rebuild_callable"])
def test_runs_without_sql(spark, small, name):
    assert ALL[name](spark, small).count() > 0
