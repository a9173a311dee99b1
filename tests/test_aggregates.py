"""Aggregate details: bucket origin (D14), averages of odd values, alert totals, dispatch counters, context phases."""

from __future__ import annotations

import datetime as dt
import math

from pulsegrid import schemas as S
from pulsegrid.operators.aggregates import alert_totals, bucket_avg, dispatch_stats, metric_stats, window_agg
from pulsegrid.operators.context import user_context
from pulsegrid.operators.joins import route_alerts


def test_weekly_buckets_start_on_monday(spark):
    rows = [(1, "heart_rate", 60.0, dt.datetime(2024, 1, 3, 12)), (1, "heart_rate", 80.0, dt.datetime(2024, 1, 7, 23)),
            (1, "heart_rate", 70.0, dt.datetime(2024, 1, 8, 0))]
    df = spark.createDataFrame(rows, "user_id long, metric string, value double, event_time timestamp")
    got = sorted((r.bucket, r.avg_value) for r in bucket_avg(df, "heart_rate", "7 days", start_time="4 days").collect())
    assert got == [(dt.datetime(2024, 1, 1), 70.0), (dt.datetime(2024, 1, 8), 70.0)]
    assert all(b.weekday() == 0 for b, _ in got)


READING = "user_id long, metric string, value double, event_time timestamp"


def test_odd_values_are_averaged_as_they_are(spark):
    """Tiny, huge, NaN and infinite readings: plain averages, no cut decimals, no failed job."""
    t = dt.datetime(2024, 1, 1)
    rows = [("tiny", 4e-7), ("tiny", 4e-7), ("huge", 1e33), ("huge", 1e33), ("nan", 70.0), ("nan", float("nan")),
            ("inf", 70.0), ("inf", float("inf")), ("null", None)]
    df = spark.createDataFrame([(1, m, v, t) for m, v in rows], READING)
    want = {"tiny": 4e-7, "huge": 1e33, "inf": float("inf"), "null": None}
    for panes in (False, True):
        got = {r.metric: r.avg_value for r in window_agg(df, panes=panes).collect()}
        assert math.isnan(got.pop("nan")) and got == want
    stats = {r.metric: r for r in metric_stats(df, None, None, [m for m in {m for m, _ in rows}]).collect()}
    assert math.isnan(stats["nan"].avg_value) and math.isnan(stats["nan"].max_value)
    assert {m: stats[m].avg_value for m in want} == want
    assert stats["tiny"].median_value == 4e-7 and stats["huge"].median_value == 1e33
    assert stats["inf"].median_value == float("inf") and stats["null"].median_value is None and stats["null"].n_samples == 1


def test_dispatch_counts_alerts_without_a_user_as_received(spark):
    alerts = spark.createDataFrame([(1,), (1,), (2,), (None,)], "user_id long")
    users = spark.createDataFrame([(1, "chat-1"), (2, None)], "user_id long, contact_id string")
    got = dispatch_stats(alerts, route_alerts(alerts, users)).first()
    assert (got.received, got.live, got.chat) == (4, 3, 2)
    none = alerts.limit(0)
    assert tuple(dispatch_stats(none, route_alerts(none, users)).first()) == (0, 0, 0)


def test_context_joins_stage_names_and_drops_null_phases(spark):
    """Two full names of one stage, and a phase key without a value, in one user's readings."""
    t = dt.datetime(2024, 1, 30, 23)
    rows = [(1, "heart_rate", 60.0, t, {"phase": p}) for p in ("HKCategoryValueSleepAnalysisAwake", "Awake", "Awake", None)]
    readings = spark.createDataFrame(rows, READING + ", metadata map<string,string>")
    users = spark.createDataFrame([(1, "n", "morning", "UTC")], "user_id long, name string, chronotype string, timezone string")
    alerts = spark.createDataFrame([], "user_id long, created_at timestamp, severity string, category string, title string, "
                                       "text string, event_id long, rule_pos int")
    journal = spark.createDataFrame([], S.JOURNAL)
    got = user_context(users, readings, alerts, journal, "2024-01-31 00:00:00", 6).first()
    assert {k: (v.n, v.pct) for k, v in got.sleep_phases.items()} == {"Awake": (3, 100.0)}


def test_alert_totals_count_each_severity(spark):
    df = spark.createDataFrame([(1, "critical"), (1, "warning"), (1, "warning"), (2, "info")],
                               "user_id long, severity string")
    got = {r.user_id: (r.total, r.critical, r.warning, r.info) for r in alert_totals(df).collect()}
    assert got == {1: (3, 1, 2, 0), 2: (1, 0, 0, 1)}
