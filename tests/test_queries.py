"""Every registered query against its SQL on the smallest data folder, and checks of the plans."""

import os

import pytest

import __spark_entry__ as entry
from inlay.operators import corpus, intervals, reindex
from inlay.plans.placement_queries import LENGTH
from inlay.plans.views import Tables
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query_matches_sql(spark, con, key):
    problem, rows, *_ = compare(spark, con, entry.queries()[key], entry.oracle_sql().get(key), FOLDER)
    assert problem is None
    assert rows > 0 or key in entry.oracle_sql()


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.where("not same").count() == 0


def plan_text(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_plans_have_no_pairing_joins(spark):
    t = Tables(spark, FOLDER)
    frames = [
        intervals.find_overlap(t.candidates, t.occupied, ["cand_id"]),
        corpus.overlay(corpus.pack_sequences(t.doc_tokens, LENGTH), reindex.reindex(t.plan, LENGTH)),
        corpus.locate_in_shards(t.table("orders").select("o_orderkey"), t.shards, "o_orderkey"),
    ]
    for df in frames:
        text = plan_text(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_column_pruning_reaches_the_scan(spark):
    text = plan_text(Tables(spark, FOLDER).occupied)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
