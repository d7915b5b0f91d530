"""Every query against its SQL, and the entry points."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.catalog import inputs
from quillspark.catalog.oracles import ORACLES
from quillspark.catalog.queries import QUERIES
from quillspark.functions import html


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got, expected = _rows(df.columns, df.collect()), _rows(columns, cursor.fetchall())
    assert len(got) == len(expected) > 0
    assert got == expected


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "markdown" in df.columns


def test_orders_of_one_row_group_are_dealt_to_tasks(spark, folder):
    rows = spark.range(25_000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority")
    rows.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    pages = inputs.order_pages(spark, folder)
    assert pages.rdd.getNumPartitions() == 3
    assert pages.select("o_orderkey").distinct().count() == pages.count() == 25_000
    markdown = html.html_to_markdown(F.col("text"))["markdown"]
    told = pages.filter("o_orderkey in (0, 24999)").select(markdown.alias("m")).collect()
    assert all(r["m"].startswith("## Order ") and r["m"].endswith("![seal](/s.png) €") for r in told) and len(told) == 2
    assert inputs.order_pages(spark, folder).filter("o_orderkey < 0").count() == 0
