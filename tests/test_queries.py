"""Every registered query of the model against its DuckDB form, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessera.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
