"""Every query with oracle SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from skyloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, db, name):
    ours, theirs = comparable(QUERIES[name](spark, sf).toPandas()), comparable(db.sql(ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        if ours[c].dtype == float:
            assert ((ours[c] - theirs[c]).abs().fillna(0) <= 2e-6 * (1 + theirs[c].abs().fillna(0))).all(), c
            assert (ours[c].isna() == theirs[c].isna()).all(), c
        elif "start" not in c:
            assert (ours[c] == theirs[c]).all(), c


def test_cones_find_rows(spark, sf):
    for name in ("adql_cone", "recipe_cone"):
        assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
