"""Rule boundaries (R1-R5), rule order, null handling and value text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.metrics import value_text
from pulsegrid.operators.rules import detect_alerts, hr_watch

P = "HKCategoryValueSleepAnalysis"
SCHEMA = "event_id long, user_id long, metric string, value double, metadata map<string,string>, event_time timestamp"


def _alerts(spark, rows):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    data = [(i, 1, m, v, ({"phase": ph} if ph is not None else None), t) for i, (m, v, ph) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    out = detect_alerts(df, created_at=F.col("event_time"), keep=["event_id"]).orderBy("event_id", "rule_pos")
    return [(r.event_id, r.rule, r.severity) for r in out.collect()]


def test_heart_rate_asleep_bounds(spark):
    rows = [("heart_rate", 90.0, P + "AsleepCore"), ("heart_rate", 90.5, P + "AsleepDeep"),
            ("heart_rate", 110.0, P + "AsleepREM"), ("heart_rate", 110.1, P + "AsleepCore"),
            ("heart_rate", 130.0, P + "InBed"), ("heart_rate", 130.0, None), ("heart_rate", None, P + "AsleepCore")]
    assert _alerts(spark, rows) == [(1, "hr_asleep", "warning"), (2, "hr_asleep", "warning"),
                                    (3, "hr_asleep", "critical")]


def test_tachycardia_bounds(spark):
    rows = [("heart_rate", 120.0, P + "Awake"), ("heart_rate", 120.5, P + "Awake"),
            ("heart_rate", 150.0, P + "AsleepCore")]
    got = _alerts(spark, rows)
    assert (1, "tachycardia", "warning") in got
    assert all(r[0] != 0 for r in got)


def test_spo2_hrv_temperature_bounds(spark):
    rows = [("oxygen", 92.0, None), ("oxygen", 91.9, None), ("oxygen", 90.0, None), ("oxygen", 89.9, None),
            ("hrv", 20.0, None), ("hrv", 19.9, None),
            ("temperature", 38.0, None), ("temperature", 38.1, None), ("temperature", 35.5, None),
            ("temperature", 35.4, None), ("movement", 0.0, None), ("sleep", 1.0, None), ("unknown", 1.0, None)]
    assert _alerts(spark, rows) == [(1, "spo2", "warning"), (2, "spo2", "warning"), (3, "spo2", "critical"),
                                    (5, "hrv", "warning"), (7, "temperature", "critical"),
                                    (9, "temperature", "warning")]


def test_rule_order_kept_for_multiple_alerts(spark):
    rows = [("heart_rate", 130.0, P + "AsleepAwake")]
    assert _alerts(spark, rows) == [(0, "hr_asleep", "critical"), (0, "tachycardia", "warning")]


def test_alert_text(spark):
    import datetime as dt
    df = spark.createDataFrame([(1, 7, "heart_rate", 95.5, {"phase": P + "AsleepDeep"}, dt.datetime(2024, 1, 1))],
                               SCHEMA)
    a = detect_alerts(df, created_at=F.col("event_time")).first()
    assert a.text == "HR=96 bpm en fase AsleepDeep. Puede indicar pesadilla, fiebre o apnea del sueño."
    assert a.phase == P + "AsleepDeep" and a.category == "cardiovascular" and a.user_id == 7


def test_value_text_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (36.25,), (1234567.0,)], "v double")
    got = [r[0] for r in df.select(value_text("v", 0)).collect()]
    assert got == ["%.0f" % x for x in (0.5, 1.5, 2.5, 36.25, 1234567.0)]
    got1 = [r[0] for r in df.select(value_text("v", 1)).collect()]
    assert got1 == ["%.1f" % x for x in (0.5, 1.5, 2.5, 36.25, 1234567.0)]


def test_hr_watch_flags_minutes(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 0, 0, 10)
    rows = [(i, 1, "heart_rate", v, None, t + dt.timedelta(seconds=i)) for i, v in enumerate([119.0, 125.0])]
    rows.append((9, 1, "heart_rate", 80.0, None, t + dt.timedelta(minutes=1)))
    df = spark.createDataFrame(rows, SCHEMA)
    out = hr_watch(df).orderBy("window_start").collect()
    assert [r.flagged for r in out] == [True, False]
    assert out[0].avg_hr == 122.0 and out[0].max_hr == 125.0
