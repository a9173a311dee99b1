"""Registered aggregation queries (A1-A16) over the fixture readings and derived alerts.

Operators give plain averages; queries and oracles round them to six places,
because the last bits of a double sum depend on its order (D15).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import aggregates as A
from ..operators.joins import route_alerts
from .catalog import query
from .common import AS_OF, CONTEXT_HOURS, alerts_of, readings_of, users_of
from .oracle_views import AS_OF as SQL_AS_OF
from .oracle_views import with_views

SCOPE = (f"event_time >= {SQL_AS_OF} - INTERVAL {CONTEXT_HOURS} HOUR AND event_time <= {SQL_AS_OF}")
AVG = "round(avg(value) + 1e-9, 6)"


def _rounded(df, *names):
    """Six places, on both sides after adding a billionth: an exact half then rounds up whatever the last bits are."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names or ("avg_value",)})


METRICS_IN = ", ".join(f"'{m}'" for m in C.CONTEXT_METRICS)


# --- A1 + A2: sliding window (flagship) -------------------------------------

A1_SQL = with_views(f"""
SELECT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, user_id, metric,
       {AVG} AS avg_value, min(value) AS min_value, max(value) AS max_value,
       count(value) AS n_samples
FROM x GROUP BY ALL
""", "readings", ctes="""
x AS (SELECT date_trunc('minute', event_time) - k * INTERVAL 1 MINUTE AS ws, r.*
      FROM readings r, range(5) g(k))""")


@query("a1_window_agg", A1_SQL)
def a1_window_agg(spark, root):
    """A1 + A2: 5-minute windows sliding by 1 minute, per user and metric, flattened."""
    return _rounded(A.flatten_window(A.window_agg(readings_of(spark, root))))


@query("a1_window_agg_panes", A1_SQL)
def a1_window_agg_panes(spark, root):
    """A1 + A2 by 1-minute panes combined into 5-minute windows (batch strategy for dense readings)."""
    return _rounded(A.flatten_window(A.window_agg(readings_of(spark, root), panes=True)))


@query("a2_flatten_window", with_views(f"""
SELECT DISTINCT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end FROM x
""", "readings", ctes="""
x AS (SELECT date_trunc('minute', event_time) - k * INTERVAL 1 MINUTE AS ws FROM readings r, range(5) g(k))"""))
def a2_flatten_window(spark, root):
    """A2: the distinct window bounds the flagship produces, as flat UTC columns."""
    return A.flatten_window(A.window_agg(readings_of(spark, root))).select(
        "window_start", "window_end").distinct()


# --- A3-A5: context statistics --------------------------------------------

@query("a3_metric_stats", with_views(f"""
SELECT user_id, metric, count(*) AS n_samples, {AVG} AS avg_value,
       min(value) AS min_value, max(value) AS max_value,
       quantile_cont(value, 0.5) AS median_value
FROM readings WHERE {SCOPE} AND metric IN ({METRICS_IN})
GROUP BY user_id, metric
""", "readings"))
def a3_metric_stats(spark, root):
    """A3: count, avg, min, max and exact median per user and metric in the context window."""
    return _rounded(A.metric_stats(readings_of(spark, root), AS_OF, CONTEXT_HOURS))


A3_SQL = with_views(f"""
SELECT user_id, metric, count(*) AS n_samples, {AVG} AS avg_value,
       min(value) AS min_value, max(value) AS max_value,
       quantile_cont(value, 0.5) AS median_value
FROM readings WHERE {SCOPE} AND metric IN ({METRICS_IN})
GROUP BY user_id, metric
""", "readings")


@query("s6_history_metric_stats", A3_SQL)
def s6_history_metric_stats(spark, root):
    """S6 + K3 + K10 + A3: readings written as the day-partitioned history, scanned back (partition
    pruning, pushed filters) and summarised."""
    from ..session import scratch_path
    from ..sources.stored import stored_readings
    from ..streaming import sinks as K

    path = scratch_path(spark, "history")
    K.layout(K.reading_rows(readings_of(spark, root))).write.partitionBy("event_date").parquet(
        path + "/readings")
    return _rounded(A.metric_stats(stored_readings(spark, path), AS_OF, CONTEXT_HOURS))


@query("a3_metric_stats_approx")
def a3_metric_stats_approx(spark, root):
    """A3 with the opt-in approximate median (one aggregation, bounded sketch per group)."""
    return _rounded(A.metric_stats(readings_of(spark, root), AS_OF, CONTEXT_HOURS, exact_median=False))


@query("a4_phase_distribution", with_views(f"""
SELECT user_id, string_split(phase, 'Analysis')[-1] AS stage, phase, count(*) AS n,
       round(100 * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 1) AS pct
FROM readings WHERE {SCOPE} AND phase IS NOT NULL
GROUP BY user_id, phase
""", "readings"))
def a4_phase_distribution(spark, root):
    """A4: per user, readings with a phase key: count and percent of the user's total."""
    return A.phase_distribution(readings_of(spark, root), AS_OF, CONTEXT_HOURS)


@query("a5_phase_counts", with_views(f"""
SELECT user_id, regexp_replace(phase, '^HKCategoryValueSleepAnalysis', '') AS stage, CAST(count(*) AS INTEGER) AS n
FROM readings WHERE phase IS NOT NULL GROUP BY ALL
""", "readings"))
def a5_phase_counts(spark, root):
    """A5: readings per stage name (anchored prefix removal) per user."""
    return A.phase_counts(readings_of(spark, root))


# --- A6-A8: trends ----------------------------------------------------------

def _trend_sql(metric: str) -> str:
    return with_views(f"""
SELECT user_id, date_trunc('hour', event_time) AS bucket, {AVG} AS avg_value
FROM readings WHERE metric = '{metric}' GROUP BY ALL
""", "readings")


@query("a6_hr_trend", _trend_sql("heart_rate"))
def a6_hr_trend(spark, root):
    """Hourly heart-rate bucket averages per user."""
    return _rounded(A.bucket_avg(readings_of(spark, root), "heart_rate", "1 hour"))


@query("a7_hrv_trend", _trend_sql("hrv"))
def a7_hrv_trend(spark, root):
    """Hourly HRV bucket averages per user."""
    return _rounded(A.bucket_avg(readings_of(spark, root), "hrv", "1 hour"))


@query("a8_trend_summary", with_views(f"""
SELECT user_id, round(avg(avg_value) + 1e-9, 6) AS mean_of_buckets, round(min(avg_value) + 1e-9, 6) AS min_of_buckets,
       round(max(avg_value) + 1e-9, 6) AS max_of_buckets, count(*) AS n_buckets
FROM (SELECT user_id, date_trunc('hour', event_time) AS bucket, avg(value) AS avg_value
      FROM readings WHERE metric = 'heart_rate' GROUP BY ALL) b
GROUP BY user_id
""", "readings"))
def a8_trend_summary(spark, root):
    """Legend mean/min/max over the hourly heart-rate bucket averages."""
    b = A.bucket_avg(readings_of(spark, root), "heart_rate", "1 hour")
    return _rounded(A.bucket_summary(b), "mean_of_buckets", "min_of_buckets", "max_of_buckets")


@query("a8_hrv_trend_summary", with_views(f"""
SELECT user_id, round(avg(avg_value) + 1e-9, 6) AS mean_of_buckets
FROM (SELECT user_id, date_trunc('hour', event_time) AS bucket, avg(value) AS avg_value
      FROM readings WHERE metric = 'hrv' GROUP BY ALL) b
GROUP BY user_id
""", "readings"))
def a8_hrv_trend_summary(spark, root):
    """The HRV legend (mean of the hourly bucket averages)."""
    b = A.bucket_avg(readings_of(spark, root), "hrv", "1 hour")
    return _rounded(A.bucket_summary(b).select("user_id", "mean_of_buckets"), "mean_of_buckets")


# --- A9-A14: alert panels -----------------------------------------------------

@query("a9_alerts_per_minute", with_views(f"""
SELECT user_id, date_trunc('minute', created_at) AS minute, count(*) AS n FROM alerts GROUP BY ALL
""", "alerts"))
def a9_alerts_per_minute(spark, root):
    """Alerts per user and minute."""
    return A.alerts_per_minute(alerts_of(spark, root))


def _per_minute_sql(severity: str) -> str:
    return with_views(f"""
SELECT user_id, date_trunc('minute', created_at) AS minute, count(*) AS n
FROM alerts WHERE severity = '{severity}' GROUP BY ALL
""", "alerts")


def _per_minute(severity: str):
    def run(spark, root):
        return A.alerts_per_minute(alerts_of(spark, root), severity)
    run.__doc__ = f"A10: {severity} alerts per user and minute."
    return run


for _sev in C.SEVERITIES:
    query(f"a10_{_sev}_per_minute", _per_minute_sql(_sev))(_per_minute(_sev))


@query("a11_alert_timeline", with_views(f"""
SELECT user_id, date_trunc('minute', created_at) AS minute, severity, count(*) AS n FROM alerts GROUP BY ALL
""", "alerts"))
def a11_alert_timeline(spark, root):
    """Alerts per user, minute and severity (long form)."""
    return A.alert_timeline(alerts_of(spark, root))


@query("a11_alert_timeline_wide", with_views(f"""
SELECT user_id, date_trunc('minute', created_at) AS minute,
       count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'warning') AS warning,
       count(*) FILTER (WHERE severity = 'info') AS info
FROM alerts GROUP BY ALL
""", "alerts"))
def a11_alert_timeline_wide(spark, root):
    """The same timeline pivoted on the three fixed severities."""
    return A.alert_timeline(alerts_of(spark, root), wide=True)


@query("a12_alert_totals", with_views(f"""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info
FROM alerts GROUP BY user_id
""", "alerts"))
def a12_alert_totals(spark, root):
    """Panel totals per user in one pass."""
    return A.alert_totals(alerts_of(spark, root))


@query("a13_alerts_by_category", with_views(f"""
SELECT user_id, category, CAST(count(*) AS INTEGER) AS n FROM alerts GROUP BY ALL
""", "alerts"))
def a13_alerts_by_category(spark, root):
    """Alerts per user and category."""
    return A.alerts_by_category(alerts_of(spark, root))


@query("a14_alert_count", with_views("SELECT count(*) AS n_alerts FROM alerts", "alerts"))
def a14_alert_count(spark, root):
    """Global alert count."""
    return A.alert_count(alerts_of(spark, root))


@query("a15_readings_by_metric", with_views(
    "SELECT metric, count(*) AS n FROM readings GROUP BY metric", "readings"))
def a15_readings_by_metric(spark, root):
    """Readings per metric."""
    return A.readings_by_metric(readings_of(spark, root))


@query("a16_dispatch_stats", with_views(f"""
SELECT count(*) AS received, count(a.user_id) AS live,
       count(CASE WHEN a.user_id IS NOT NULL THEN u.contact_id END) AS chat
FROM alerts a LEFT JOIN users u ON a.user_id = u.user_id
""", "alerts", "users"))
def a16_dispatch_stats(spark, root):
    """Alerts received, and those sent to the live and the chat channel (J1 left join)."""
    alerts = alerts_of(spark, root)
    return A.dispatch_stats(alerts, route_alerts(alerts, users_of(spark, root)))
