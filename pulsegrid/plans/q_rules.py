"""Registered rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import short_stage, value_text
from ..operators import rules as R
from .catalog import query
from .common import AS_OF, readings_of
from .oracle_views import AS_OF as SQL_AS_OF
from .oracle_views import with_views

ALERT = ", ".join(R.ALERT_COLUMNS)


def _single(name: str):
    def run(spark, root):
        out = R.single_rule(readings_of(spark, root), name, created_at=F.col("event_time"), keep=["event_id"])
        return out.drop("rule_pos")
    run.__doc__ = f"Rule {name} alone over all readings (alerts stamped with the event time)."
    return run


for _id, _name in [("r1", "hr_asleep"), ("r2", "tachycardia"), ("r3", "spo2"), ("r4", "hrv"),
                   ("r5", "temperature")]:
    query(f"{_id}_rule_{_name}", with_views(
        f"SELECT {ALERT}, rule, event_id FROM alerts WHERE rule = '{_name}'", "alerts"))(_single(_name))


@query("r6_detect_alerts", with_views(f"SELECT {ALERT}, rule, rule_pos, event_id FROM alerts", "alerts"))
def r6_detect_alerts(spark, root):
    """All rules on all readings, rule order kept, 0..n alerts per reading."""
    return R.detect_alerts(readings_of(spark, root), created_at=F.col("event_time"), keep=["event_id"])


@query("r7_alert_record", with_views(
    f"SELECT user_id, {SQL_AS_OF} AS created_at, severity, category, title, text, metric, value, phase "
    "FROM alerts", "alerts"))
def r7_alert_record(spark, root):
    """The alert record alone, stamped by a fixed clock."""
    return R.detect_alerts(readings_of(spark, root), created_at=AS_OF).select(*R.ALERT_COLUMNS)


@query("r8_value_text", with_views("""
SELECT event_id, metric,
       CASE WHEN metric IN ('heart_rate', 'hrv') THEN printf('%.0f', value) ELSE printf('%.1f', value) END
         AS value_text,
       string_split(phase, 'Analysis')[-1] AS stage
FROM readings
""", "readings"))
def r8_value_text(spark, root):
    """Value text (0 places for HR/HRV, 1 otherwise) and short stage name per reading."""
    r = readings_of(spark, root)
    vt = F.when(F.col("metric").isin("heart_rate", "hrv"), value_text("value", 0)).otherwise(
        value_text("value", 1))
    return r.select("event_id", "metric", vt.alias("value_text"),
                    short_stage(F.col("metadata").getItem("phase")).alias("stage"))


@query("r9_hr_watch", with_views(f"""
SELECT date_trunc('minute', event_time) AS window_start,
       date_trunc('minute', event_time) + INTERVAL 1 MINUTE AS window_end, user_id,
       round(avg(value) + 1e-9, 6) AS avg_hr, max(value) AS max_hr, count(value) AS n_samples,
       avg(value) > 120 AS flagged
FROM readings WHERE metric = 'heart_rate' GROUP BY ALL
""", "readings"))
def r9_hr_watch(spark, root):
    """1-minute tumbling heart-rate average/max per user, flagged above 120."""
    return R.hr_watch(readings_of(spark, root)).withColumn("avg_hr", F.round(F.col("avg_hr") + 1e-9, 6))
