"""Plan shapes that matter at scale."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import ordered
from tallyhouse.plans import ingest, sales, scoring, service
from tallyhouse.plans.star import Star
from tallyhouse.registry import all_queries

WRITES = ("ingest_", "ledger_", "results_")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in all_queries() if not n.startswith(WRITES)])
def test_no_pair_joins_and_no_python(spark, folder, name):
    text = plan(all_queries()[name](spark, folder))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF"):
        assert operator not in text


def test_first_per_key_limits_groups_before_the_exchange(spark, folder):
    star = Star(spark, folder)
    for frame in (ingest.ingest_first_wins_dedupe(star), service.ex06_latest_review_per_order(star)):
        text = plan(frame)
        assert text.index("WindowGroupLimit") < text.rindex("Exchange hashpartitioning")
        assert "Partial" in text


def test_scan_reads_only_needed_columns_and_pushes_filters(spark, folder):
    text = plan(Star(spark, folder).orders.where("order_status = 'delivered'").select("order_id"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    dated = plan(sales.ex13_sellers_4hop_date_range(Star(spark, folder)))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in dated


def test_fact_is_summed_before_the_join(spark, folder):
    text = plan(sales.m04_top_categories_revenue(Star(spark, folder)))
    assert "TakeOrderedAndProject" in text
    assert text.index("keys=[product_id") > text.index("Join")


def test_blocks_of_a_group_are_spread(spark):
    keys = spark.range(100).selectExpr("id % 2 as g", "id as k", "1 as n")
    text = plan(ordered.ordered_runs(keys, ["g"], F.col("k"), {"n": "start"}, rows_per_block=10))
    assert "REPARTITION_BY_COL" in text and "_coarse" in text and "_fine" in text
    assert "REPARTITION_BY_COL" not in plan(ordered.ordered_runs(keys, ["g"], F.col("k"), {"n": "start"}))


def test_percentiles_exchange_bins_and_few_values(spark, folder):
    """Bins are exchanged while it is built; after that counts of the values left, and a row a run or two."""
    text = plan(scoring.eval_latency_percentiles(Star(spark, folder)))
    assert text.count("Exchange hashpartitioning(run_no") <= 4
    # What is read of the events moves as counts only.
    assert "partial_count" in text and "rangepartitioning" not in text and "Repartition" not in text
