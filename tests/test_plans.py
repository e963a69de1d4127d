"""Plan-shape guarantees that matter at scale (checked on the physical plan text)."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from opsdeck.functions.urls import default_url_rules
from opsdeck.operators.collapse import last_by
from opsdeck.operators.joins import salted_join
from opsdeck.plans.traffic import endpoint_stats
from test_access_log import line, lines_df


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_endpoint_stats_plan(spark):
    df = endpoint_stats(lines_df(spark, [line(url=f"/u/{i}") for i in range(50)]), "edge_proxy",
                        default_url_rules("REF"))
    plan = physical(df)
    assert plan.count("Exchange hashpartitioning") == 1          # one shuffle, keyed by (method, url)
    assert "mode=Partial" in plan or "partial_count" in plan    # map-side combine before it
    assert "TakeOrderedAndProject" in plan                      # top-k, no full sort
    assert "Generate" in plan
    # the log pattern is evaluated once per line (no second copy pushed into a filter)
    assert len(re.findall(r"regexp_replace\(value", plan)) == 1
    assert "Window" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_last_by_is_a_partial_aggregate(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos"),
                                     F.col("id").cast("string").alias("v"))
    plan = physical(last_by(df, ["k"], ["pos"]))
    assert "Window" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_max_by" in plan


def test_hot_key_collapse_is_correct(spark):
    # one key holds two thirds of the rows, spread over all input partitions
    n = 60000
    df = spark.range(0, n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
        .otherwise(F.lit("hot")).alias("k"), F.col("id").alias("pos"), (F.col("id") * 7).alias("v"))
    out = {r.k: (r.pos, r.v) for r in last_by(df, ["k"], ["pos"]).collect()}
    assert out["hot"] == (n - 1, (n - 1) * 7)
    assert len(out) == 1001


@pytest.fixture
def no_broadcast(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_salted_join_splits_a_hot_key(spark, no_broadcast):
    rows = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                       F.col("id").alias("item"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = salted_join(rows, lookup, "k", "item")
    assert "BroadcastHashJoin" not in physical(joined)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 3000     # no single task holds the key
    assert joined.filter("k = 'hot' and n <> 3000").count() == 0 and joined.count() == 9000
    left = salted_join(rows, lookup.filter("k <> 'hot'"), "k", "item", "left")
    assert left.count() == 9000 and left.filter("n is null").count() == 3000


def test_digest_spreads_a_hot_owner(spark, no_broadcast):
    from report_helpers import make_instances
    from opsdeck.plans.digests import with_owner_header
    rows = [{"instance_id": f"i-{i}"} for i in range(300)]
    items = make_instances(spark, rows).select(
        F.when(F.pmod(F.hash("instance_id"), F.lit(3)) > 0, F.lit("hot")).otherwise(F.col("instance_id")).alias("owner"),
        F.col("instance_id").alias("build"))
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_owner_header(items)
        assert out.filter("owner = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)


def test_extension_collapses_before_the_join(spark, no_broadcast):
    from report_helpers import make_instances
    from opsdeck.plans.lifecycle import extend_lifetime
    inst = make_instances(spark, [{"instance_id": "i-1", "tags": {"role": "test", "build": "a", "terminate_after": "x"}}])
    plan = physical(extend_lifetime(inst, spark.createDataFrame([("a", 1.0)], "build string, hours double")))
    join = plan.index("SortMergeJoin")
    assert plan.find("Aggregate") > join and plan.count("Aggregate") >= 4    # both sides, below the join


def test_inventory_scan_pruned_and_pushed(spark):
    from opsdeck.plans.lifecycle import nightly_plan
    from opsdeck.sources.landing import land
    from report_helpers import make_instances
    inst = land(make_instances(spark, [{"instance_id": "i-1", "tags": {"role": "test", "terminate_after": ""}}]),
                "plan_test")
    text = formatted(nightly_plan(inst, "2001-07-31 12:00:00"))
    assert "EqualTo(state,running)" in text
    read = re.search(r"ReadSchema: (struct<[^\n]*>)", text).group(1)
    assert "launch_time" not in read and "private_ip" not in read and "res_pos" not in read


def test_digest_scans_inventory_once(spark):
    from report_helpers import AS_OF, ago, make_instances
    from opsdeck.plans.digests import age_digest
    from opsdeck.sources.landing import land

    rows = [{"instance_id": f"i-{i}", "launch": ago(3 + i % 4),
             "tags": {"role": "test", "build": f"b{i % 7}", "launched_by_email": f"u{i % 3}@e"}} for i in range(60)]
    inst = land(make_instances(spark, rows), "digest_plan_test")
    df = age_digest(inst, AS_OF, ignore_owner="none@e")
    df.collect()  # AQE decides exchange reuse while executing
    final = formatted(df).split("\n\n\n")[0].split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert final.count("Scan parquet") == 1


def test_inventory_pages_take_one_narrow_shuffle(spark, no_broadcast, monkeypatch):
    from opsdeck.operators.nested import nest_instances
    from opsdeck.sources import fixtures as fx
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 500)
    sf = "/root/testdata/sf0.001"
    pages = nest_instances(fx.raw_instances(spark, sf, 10), page_size=10)
    plan = physical(pages)
    assert plan.count("Exchange hashpartitioning") == 3   # both sides of the join with customers, and the pages'
    pages_shuffle = plan[plan.index("REPARTITION_BY_NUM"):]
    assert "launched_by_email" in pages_shuffle and "AS Tags" not in pages_shuffle    # tags are built after it
    flat = nest_instances(fx.raw_instances(spark, sf), page_size=10)
    key = ["page", "Reservations"]
    assert sorted(map(str, pages.select(key).collect())) == sorted(map(str, flat.select(key).collect()))
