"""Physical-plan checks on a day-partitioned reading history (K3 + K10 layout)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.aggregates import metric_stats, window_agg
from pulsegrid.operators.history import in_scope, recent_alerts
from pulsegrid.operators.joins import route_alerts
from pulsegrid.operators.rules import detect_alerts
from pulsegrid.plans.common import alerts_of, readings_of, users_of
from pulsegrid.sources.stored import stored_readings
from pulsegrid.streaming import sinks as K

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("hist"))
    rows = K.layout(K.reading_rows(readings_of(spark, SF_SMALL)))
    rows.write.partitionBy("event_date").parquet(os.path.join(root, "readings"))
    return stored_readings(spark, root)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_guards_reach_the_scan(history):
    plan = _plan(detect_alerts(history, created_at=F.col("event_time")))
    assert "PushedFilters" in plan and "metric" in plan.split("PushedFilters")[1][:600]


def test_time_scope_prunes_day_partitions(history):
    scoped = in_scope(history, start="2024-01-10 00:00:00", end="2024-01-12 00:00:00", metrics=["heart_rate"])
    plan = _plan(scoped)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert scoped.count() == history.where(
        "event_time BETWEEN '2024-01-10' AND '2024-01-12 00:00:00' AND metric = 'heart_rate'").count()


def test_projection_prunes_columns(history):
    plan = _plan(window_agg(history).select("user_id"))
    read_schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "source" not in read_schema and "metadata" not in read_schema


def test_context_stats_shuffle_little(history):
    """A3 on a history: slices, groups, and the median's slice rows; the scans are pruned to three columns."""
    df = metric_stats(history, "2024-01-31 00:00:00", 720)
    df.collect()
    final = _plan(df).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in final and "rangepartitioning" not in final
    assert all("source" not in part.split("\n")[0] for part in final.split("ReadSchema: ")[1:])


def test_user_dimension_join_is_size_checked(spark):
    plan = _plan(route_alerts(alerts_of(spark, SF_SMALL), users_of(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in plan or "SortMergeJoin" in plan


def test_top_n_alerts_limits_before_shuffle(spark):
    plan = _plan(recent_alerts(alerts_of(spark, SF_SMALL), 10))
    assert "WindowGroupLimit" in plan


def test_user_scope_is_pushed_and_exact(history):
    uid = history.select("user_id").first()[0]
    scoped = in_scope(history, user_id=uid, start="2024-01-01 00:00:00", end="2024-01-31 00:00:00")
    assert "EqualTo(user_id" in _plan(scoped)
    assert scoped.count() == history.where(F.col("user_id") == uid).count()


def test_hot_user_join_is_split_by_aqe(spark):
    """One user holds a third of the alerts; with broadcast off, AQE splits that partition."""
    alerts = spark.range(300000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("user_id"),
        F.col("id").alias("event_id"))
    users = spark.range(5000).select(F.col("id").alias("user_id"),
                                     F.concat(F.lit("chat-"), F.col("id").cast("string")).alias("contact_id"))
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions",
            "spark.sql.adaptive.coalescePartitions.enabled"]
    saved = {k: spark.conf.get(k) for k in keys}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        routed = route_alerts(alerts, users)
        n = routed.where(F.col("contact_id").isNotNull()).count()
        routed.collect()
        final = _plan(routed).split("== Initial Plan ==")[0]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert n == 300000
    assert "SortMergeJoin" in final and "skew=true" in final
