"""Plan shapes that must hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from crowdpanel.plans.registry import QUERIES, shared_tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_survey_id_and_most_have_sql():
    assert all(q.ids for q in QUERIES.values())
    assert len(entry.oracle_sql()) >= 0.9 * len(QUERIES)


def test_rolling_baseline_needs_one_exchange(spark):
    from crowdpanel.operators.baseline import rolling_baseline
    rows = shared_tables(spark, SF).unit_evening.withColumnRenamed("is_control", "clean_control_strict")
    assert len(re.findall(r"Exchange hashpartitioning", _plan(rolling_baseline(rows)))) == 1


@pytest.mark.parametrize("name", ["game_effects", "hourly_lifts", "asof_last_purchase", "cell_hour", "basket_cosine_edges", "units_within_radius", "contiguity_edges"])
def test_no_nested_loops(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert not re.search(r"BroadcastNestedLoopJoin BuildRight, Inner, \(", plan)


def test_dense_panel_is_one_shuffle_of_the_fact(spark):
    t = shared_tables(spark, SF)
    from crowdpanel.operators.panel import dense_hours
    from pyspark.sql import functions as F
    fact = spark.sql("select 1 ring_id, date'2024-01-01' date, 3 hour from range(10)")
    plan = _plan(dense_hours(fact, t.rings, ["ring_id"], "2024-01-01", "2024-01-02", {"n": F.lit(1)}))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_date_filters_and_columns_reach_the_scan(spark):
    t = shared_tables(spark, SF)
    plan = _plan(t.table("lineitem").filter("l_shipdate >= timestamp_ntz'2000-01-01 00:00:00'").groupBy("l_returnflag").count())
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert re.search(r"ReadSchema: struct<l_returnflag:string,l_shipdate:timestamp_ntz>", plan)


def test_top_k_is_limited_before_the_shuffle(spark):
    from crowdpanel.operators.windows import top_k
    from pyspark.sql import functions as F
    plan = _plan(top_k(spark.range(10).withColumn("g", F.col("id") % 2), ["g"], [F.col("id")], 3))
    assert plan.count("WindowGroupLimit") == 2


def test_cosine_join_sends_packed_lists(spark, monkeypatch):
    """What a holder meets goes as arrays of a number and a rounded weight, not as one row a meeting; no vectors are broadcast by the size of a compressed file."""
    from crowdpanel.operators import graph
    sent = []
    keep = graph.durable_table
    monkeypatch.setattr(graph, "durable_table", lambda df: (sent.append(_plan(df)), keep(df))[1])
    monkeypatch.setattr(graph, "TASK_PAIRS", 1000)
    edges = graph.cosine_edges(spark.range(300).selectExpr("id % 60 AS node_id", "id * 7 % 11 AS key", "1.0D + id % 3 AS w").distinct())
    pairs = next(p for p in sent if "xu#" in p)
    assert re.search(r"Exchange hashpartitioning\(src#\d+, \d+\), REPARTITION_BY_NUM", pairs) and "Join" not in pairs
    assert "BroadcastHashJoin" not in _plan(edges) and edges.count() > 0
