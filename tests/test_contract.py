"""Every query with SQL returns what that SQL returns in another engine."""

import duckdb
import pytest

from triagelake.plans import contract, inputs  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(df[cols].astype(object).where(df[cols].notna(), None).astype(str).values.tolist()), cols


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query(spark, oracle, name):
    assert rows_of(contract.QUERIES[name](spark, SF).toPandas()) == rows_of(oracle.sql(contract.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
