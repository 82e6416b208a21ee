"""Every query with SQL gives the same rows in another engine."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur.plans import oracle
from larkspur.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_rows_agree(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    sql = con.sql(oracle.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    ours = Counter(tuple(r) for r in df.select(*columns).collect())
    assert ours == Counter(sql.select(*[f'"{c}"' for c in columns]).fetchall())
    spark.catalog.clearCache()


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) == set(oracle.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
