"""Corpus queries against their SQL."""

import os

import duckdb
import pandas as pd
import pytest

from chronolens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        path = f"{small}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    own, other = queries.QUERIES[name](spark, small).toPandas(), con.sql(queries.SQL[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(other.columns)
    plain = lambda f: sorted(tuple("null" if x is None or pd.isna(x) is True else str(x) for x in r) for r in f[columns].itertuples(index=False))
    assert plain(own) == plain(other)
