"""Every registered query against its SQL, on the same files."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tilewright import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (not isinstance(v, (str, list, np.ndarray)) and pd.isna(v)):
            return "NULL"
        if isinstance(v, (float, np.floating)):
            return f"{round(float(v), 5) + 0.0:.5f}"
        return str(v.item() if isinstance(v, np.generic) else v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_twice_alike(spark, sf_dir, name):
    a, b = (QUERIES[name](spark, sf_dir).toPandas() for _ in range(2))
    assert rows(a) == rows(b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
