"""Every query of the library that has SQL, against DuckDB at sf0.01, exactly but for the last digits of doubles."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from creasework.functions import exprs
from creasework.plans import oracle

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "date" in c:
            df[c] = df[c].map(lambda x: str(x)[:10])
            continue
        numbers = pd.to_numeric(df[c], errors="coerce").astype(float)
        df[c] = numbers.round(9) if numbers.notna().sum() == df[c].notna().sum() else df[c].astype(str)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, atol=1e-9, rtol=1e-9)


@pytest.mark.parametrize(("runs", "balls", "scale", "want"), [(121, 80, 6, 9.07), (2.675, 1, 1, 2.68), (0.125, 1, 1, 0.12), (0.375, 1, 1, 0.38), (-0.125, 1, 1, -0.12), (1, 0, 1, None)])
def test_ties_are_rounded_as_arrays_are(spark, runs, balls, scale, want):
    d = spark.createDataFrame([(float(runs), balls)], "runs double, balls int")
    assert d.select(exprs.ratio("runs", "balls", scale)).first()[0] == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
