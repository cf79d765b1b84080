"""Every query with SQL against DuckDB on the smallest tables whose points are unique, and the permutation test."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from cairn.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


NAMES = sorted(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    a, b = (d[columns].sort_values(columns, ignore_index=True) for d in (got, want))
    for c in columns:
        assert ((a[c].astype(str) == b[c].astype(str)) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", ["m00_merge_then_metrics", "w02_fragments", "a48_surface_visibility"])
def test_partitioning_does_not_matter(spark, name):
    before = QUERIES[name](spark, DATA).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        after = QUERIES[name](spark, DATA).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    columns = list(before.columns)
    assert before.sort_values(columns, ignore_index=True).equals(after.sort_values(columns, ignore_index=True))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
