"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from tallyloom.plans import analytics, domain  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def one(v):
        if pd.isna(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(analytics.ORACLES))
def test_matches_sql(spark, duck, name):
    ours = analytics.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(analytics.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(analytics.QUERIES) - set(analytics.ORACLES)))
def test_runs(spark, name):
    assert analytics.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
