"""Bridge and decoder edge cases (P1-P10, S2, S3) and text rendering."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from pulsegrid import constants as C
from pulsegrid.functions.classify import band, quality_category, quality_score
from pulsegrid.functions.metrics import metric_of, route_key, topic_matches
from pulsegrid.operators import ingest as I
from pulsegrid.operators.render import alert_message, prompt_text


def test_metric_map_and_unknown(spark):
    df = spark.createDataFrame([(C.HK_HEART_RATE,), (C.HK_RESTING_HEART_RATE,), (None,), (C.HK_SLEEP_ANALYSIS,)],
                               "t string")
    assert [r[0] for r in df.select(metric_of("t")).collect()] == ["heart_rate", "unknown", "unknown", "sleep"]


def test_route_key_and_topic_filter(spark):
    df = spark.createDataFrame([(5, "a/b/c"), (None, "a/b"), (7, "a/b/c/d")], "u long, topic string")
    out = df.select(route_key("u").alias("k"), topic_matches("topic", "a/b/+").alias("one"),
                    topic_matches("topic", "a/#").alias("all")).collect()
    assert [(r.k, r.one, r.all) for r in out] == [("5", True, True), ("anonymous", False, True),
                                                   ("7", False, True)]


def test_bridge_decode_roundtrip_and_quarantine(spark):
    good = {"user_id": 3, "type": C.HK_OXYGEN_SATURATION, "unit": "%", "value": 91.5,
            "start_date": "2024-01-02T03:04:05.000001+00:00", "end_date": "2024-01-02T03:04:05.000001+00:00",
            "metadata": {"phase": C.STAGE_PREFIX + "Awake", "intensity": 0.25}, "extra_field": "kept"}
    bad_time = dict(good, start_date="yesterday", user_id=None)
    msgs = spark.createDataFrame([(1, "wearable/devices/oxygen", json.dumps(good)),
                                  (2, "wearable/devices/oxygen", json.dumps(bad_time)),
                                  (3, "wearable/devices/oxygen", "{not json")], "offset long, topic string, payload string")
    msgs = msgs.withColumn("timestamp", F.current_timestamp())
    records, bad = I.bridge(msgs, now="2024-01-31 00:00:00")
    assert [r.offset for r in bad.collect()] == [3]
    rec = {r.offset: r for r in records.collect()}
    assert rec[1].topic == "biometrics.oxygen" and rec[1].key == "3" and rec[2].key == "anonymous"
    doc = json.loads(rec[1].value)
    assert doc["metric"] == "oxygen" and doc["bridge"] == C.BRIDGE_TAG and doc["extra_field"] == "kept"
    assert doc["metadata"]["intensity"] == 0.25
    dec = {r.offset: r for r in I.decode_marked(records.drop("metric")).collect()}
    assert dec[1].metadata["intensity"] == "0.25" and dec[1].reason is None and dec[2].reason == "no user"
    assert dec[1].event_time == dt.datetime(2024, 1, 2, 3, 4, 5, 1)
    assert dec[2].event_time is None
    assert dec[1].kafka_topic == "biometrics.oxygen"


def test_encode_omits_null_metadata_and_defaults_dates(spark):
    df = spark.createDataFrame([(1, C.HK_HEART_RATE, "count/min", 60.0, None, None, None)],
                               "user_id long, type string, unit string, value double, start_date string, "
                               "end_date string, metadata map<string,string>")
    doc = json.loads(I.encode_readings(df, now="2024-01-31 00:00:00").first().json)
    assert "metadata" not in doc
    assert doc["start_date"] == doc["end_date"] == "2024-01-31T00:00:00+00:00"


def test_ingest_counts_rollup(spark):
    df = spark.createDataFrame([("hrv",), ("hrv",), ("oxygen",)], "metric string")
    assert sorted(tuple(r) for r in I.ingest_counts(df).collect()) == [("hrv", 2), ("oxygen", 1), ("total", 3)]


def test_alert_message_optional_lines(spark):
    df = spark.createDataFrame([("critical", "T", "body", "oxygen", 89.5), ("odd", None, None, "", None)],
                               "severity string, title string, text string, metric string, value double")
    msgs = [r[0] for r in df.select(alert_message(df)).collect()]
    assert msgs[0] == "🚨 *T*\n\nbody\n\n_Métrica:_ `oxygen`\n_Valor:_ `89.5`\n\n— " + C.NOTIFICATION_SIGNATURE
    assert msgs[1] == "📊 *Alerta*\n\n\n\n— " + C.NOTIFICATION_SIGNATURE


def test_prompt_presets(spark):
    df = spark.createDataFrame([("pre_sleep", True, "CTX"), ("weird", True, None), ("post_sleep", False, "CTX")],
                               "p string, inc boolean, md string")
    out = [r[0] for r in df.select(prompt_text(F.col("p"), F.col("inc"), F.col("md"))).collect()]
    assert out[0] == C.PROMPT_BASE + "\n\n" + C.PROMPT_PRE_SLEEP + "\n\nCTX"
    assert out[1] == C.PROMPT_BASE
    assert out[2] == C.PROMPT_BASE + "\n\n" + C.PROMPT_POST_SLEEP


def test_iso_text_like_python_isoformat(spark):
    import datetime as dt
    from pulsegrid.operators.ingest import iso_text
    ts = [dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 31, 1, 2, 3, 45)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp")
    got = [r[0] for r in df.select(iso_text(F.col("t"))).collect()]
    assert got == [t.replace(tzinfo=dt.timezone.utc).isoformat() for t in ts]


def test_bands_and_quality(spark):
    df = spark.createDataFrame([("heart_rate", 79.9), ("heart_rate", 80.0), ("heart_rate", 100.0),
                                ("temperature", 36.1), ("hrv", 10.0), ("respiration", 15.0)], "m string, v double")
    assert [r[0] for r in df.select(band("v", "m")).collect()] == ["green", "orange", "red", "green", "red", None]
    q = spark.createDataFrame([(6.0,), (6.01,), (8.0,), (8.5,), (12.0,), (0.2,)], "q double")
    got = [(r[0], r[1]) for r in q.select(quality_category("q"), quality_score("q")).collect()]
    assert got == [("Insuficiente", 60.0), ("Buena", 60.1), ("Buena", 80.0), ("Excelente", 85.0),
                   ("Excelente", 100.0), ("Insuficiente", 10.0)]


def test_decode_marks_null_and_bad_values(spark):
    df = spark.createDataFrame([(1, None, "t", None), (2, "{bad", "t", None), (3, '{"user_id": 5}', "t", None)],
                               "offset long, value string, topic string, timestamp timestamp")
    got = sorted(tuple(r) for r in I.decode_marked(df).select("offset", "user_id", "event_time", "reason").collect())
    assert got == [(1, None, None, "unreadable"), (2, None, None, "unreadable"), (3, 5, None, "no metric")]
    assert I.decode(df).count() == 0
