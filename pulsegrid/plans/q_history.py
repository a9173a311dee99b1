"""Registered history queries (T1-T6) and filters/classification."""

from __future__ import annotations

from ..functions.classify import band, band_of
from ..functions.metrics import get_key, has_key, short_stage
from ..operators import aggregates as A
from ..operators import history as H
from ..sources import fixtures as X
from .. import constants as C
from .catalog import query
from .common import AS_OF, CONTEXT_HOURS, alerts_of, dates_as_timestamps, readings_of
from .oracle_views import AS_OF as SQL_AS_OF
from .oracle_views import with_views

SCOPE = f"event_time >= {SQL_AS_OF} - INTERVAL {CONTEXT_HOURS} HOUR AND event_time <= {SQL_AS_OF}"


@query("t1_latest_reading", with_views(f"""
SELECT user_id, metric, event_time, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, metric ORDER BY event_time DESC, event_id DESC) AS rn
  FROM readings WHERE {SCOPE} AND metric IN ('heart_rate', 'hrv', 'oxygen', 'temperature')) t
WHERE rn = 1
""", "readings"))
def t1_latest_reading(spark, root):
    """Latest HR, HRV, SpO2 and temperature reading per user in the range."""
    return H.latest_reading(readings_of(spark, root), AS_OF, CONTEXT_HOURS)


def _recent_sql(n: int) -> str:
    return with_views(f"""
SELECT user_id, rn, created_at, severity, category, title, text, event_id, rule_pos FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC, rule_pos ASC)
             AS INTEGER) AS rn
  FROM alerts) t
WHERE rn <= {n}
""", "alerts")


def _recent(n: int, tag: str):
    def run(spark, root):
        return H.recent_alerts(alerts_of(spark, root), n).select(
            "user_id", "rn", "created_at", "severity", "category", "title", "text", "event_id", "rule_pos")
    run.__doc__ = f"{tag}: newest {n} alerts per user."
    return run


for _n, _name, _tag in [(5, "t2_recent_alerts_5", "T2 (manual check)"),
                        (10, "t2_recent_alerts_10", "T2 (context snapshot)"),
                        (20, "t2_recent_alerts_20", "T2 (live panel)"),
                        (30, "t2_recent_alerts_30", "T2 (alerts API)"),
                        (100, "t6_alert_buffer_100", "T6 (rolling client buffer)")]:
    query(_name, _recent_sql(_n))(_recent(_n, _tag))


@query("t3_latest_journal", with_views("""
SELECT user_id, CAST(entry_date AS TIMESTAMP) AS entry_date, seq, mood, stress_level, caffeine_after_17, alcohol,
       screens_min_before_bed, notes
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY entry_date DESC, seq DESC) AS rn FROM journal) t
WHERE rn = 1
""", "journal"))
def t3_latest_journal(spark, root):
    """Latest journal entry per user."""
    return dates_as_timestamps(H.latest_journal(X.journal(spark, root)))


@query("t4_chat_history", with_views("""
SELECT user_id, conv_id, turn, role, content, created_at, rn,
       count(*) OVER (PARTITION BY user_id) - rn + 1 AS position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, conv_id DESC, turn DESC)
             AS INTEGER) AS rn
  FROM chat_turns) t
WHERE rn <= 50
""", "chat_turns"))
def t4_chat_history(spark, root):
    """T4: last 50 chat messages per user (rn 1 = newest, position 1 = oldest shown)."""
    return H.chat_history(X.chat_turns(spark, root), 50).select(
        "user_id", "conv_id", "turn", "role", "content", "created_at", "rn", "position")


@query("t5_phase_order", with_views(f"""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pct DESC, stage ASC) AS INTEGER) AS position,
       stage, pct
FROM (SELECT user_id, string_split(phase, 'Analysis')[-1] AS stage,
             round(100 * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 1) AS pct
      FROM readings WHERE {SCOPE} AND phase IS NOT NULL GROUP BY user_id, phase) d
""", "readings"))
def t5_phase_order(spark, root):
    """T5: each user's stages ordered by percent, descending (array_sort over the user's few stages)."""
    return H.stage_order(A.phase_distribution(readings_of(spark, root), AS_OF, CONTEXT_HOURS))


@query("c1_scope_readings", with_views("""
SELECT event_id, user_id, metric, value FROM readings
WHERE event_time >= TIMESTAMP '2024-01-10 00:00:00' AND event_time <= TIMESTAMP '2024-01-20 00:00:00'
  AND metric IN ('heart_rate', 'oxygen')
""", "readings"))
def c1_scope_readings(spark, root):
    """Time range and metric IN-list predicates on readings."""
    return H.in_scope(readings_of(spark, root), start="2024-01-10 00:00:00", end="2024-01-20 00:00:00",
                      metrics=["heart_rate", "oxygen"]).select("event_id", "user_id", "metric", "value")


@query("c1_scope_alerts", with_views("""
SELECT user_id, created_at, title, event_id FROM alerts
WHERE severity = 'critical' AND created_at >= TIMESTAMP '2024-01-15 00:00:00'
""", "alerts"))
def c1_scope_alerts(spark, root):
    """Severity equality and time range on alerts."""
    return H.in_scope(alerts_of(spark, root), start="2024-01-15 00:00:00", severity="critical",
                      time_col="created_at").select("user_id", "created_at", "title", "event_id")


@query("c2_metadata_keys", with_views(
    "SELECT event_id, phase IS NOT NULL AS has_phase, phase FROM readings", "readings"))
def c2_metadata_keys(spark, root):
    """Key test (?) and extraction (->>) on the metadata map."""
    r = readings_of(spark, root)
    return r.select("event_id", has_key("metadata", "phase").alias("has_phase"),
                    get_key("metadata", "phase").alias("phase"))


@query("c3_short_stage", with_views(
    "SELECT event_id, string_split(phase, 'Analysis')[-1] AS stage FROM readings WHERE phase IS NOT NULL",
    "readings"))
def c3_short_stage(spark, root):
    """Short stage name (text after the last 'Analysis')."""
    r = readings_of(spark, root)
    return r.where(has_key("metadata", "phase")).select(
        "event_id", short_stage(get_key("metadata", "phase")).alias("stage"))


def _band_case(metric: str) -> str:
    bands = C.BANDS[metric]
    parts = []
    for lower, label in reversed(bands):
        cond = "value IS NOT NULL" if lower is None else f"value >= {lower}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


@query("c4_reading_bands", with_views(f"""
SELECT event_id, metric, value,
  CASE metric WHEN 'heart_rate' THEN {_band_case('heart_rate')} WHEN 'hrv' THEN {_band_case('hrv')}
              WHEN 'oxygen' THEN {_band_case('oxygen')} WHEN 'temperature' THEN {_band_case('temperature')}
  END AS band
FROM readings
""", "readings"))
def c4_reading_bands(spark, root):
    """C4: dashboard threshold band of every reading (lower bound inclusive)."""
    r = readings_of(spark, root)
    return r.select("event_id", "metric", "value", band("value", "metric").alias("band"))


@query("c4_alert_total_band", with_views(f"""
SELECT user_id, count(*) AS total,
       {_band_case('alert_total').replace('value', 'count(*)')} AS band
FROM alerts GROUP BY user_id
""", "alerts"))
def c4_alert_total_band(spark, root):
    """C4: band of each user's alert total (5 / 10)."""
    totals = A.alert_totals(alerts_of(spark, root))
    return totals.select("user_id", "total", band_of("total", C.BANDS["alert_total"]).alias("band"))
