"""Every registered query against its oracle SQL on the smallest tables, and plan checks."""

import os

import pytest

import __spark_entry__ as contract
from checks.registry import all_queries
from checks.verify import compare, connect

SMALL = "/root/testdata/sf0.001"
# Other subpackages test their own queries.
QUERIES, ORACLES = {n: q for n, q in contract.queries().items() if n in all_queries()}, contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_oracle(spark, duck, name):
    count, same, why = compare(spark, SMALL, QUERIES[name], ORACLES.get(name), duck)
    assert same is not False, why
    assert count > 0


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["O4_pages", "W1_neighbours_big_folders", "A5_folder_table", "D6_resolve_metadata", "J1_attach_sidecars", "J6_child_folders"])
def test_no_pair_joins(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_covers_keep_few_rows_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["A4_covers"](spark, SMALL))


def test_filters_and_columns_reach_the_scan(spark):
    from pixledger.operators.folders import image_counts

    spark.sql("SELECT event_type AS folder, props AS name, ts AS mtime FROM parquet.`/root/testdata/sf0.001/events.parquet`").createOrReplaceTempView("listed")
    text = plan(image_counts(spark.table("listed").where("folder = 'click'")))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text
    assert "ReadSchema: struct<event_type:string,props:string>" in text


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0
