"""Registered ingest queries: bridge steps (P1-P10) and the stream decoder.

The device messages come from the ``wire`` adapter (readings encoded by
P10, with an unmapped type where ``event_id % 25 = 7`` and an unreadable
payload where ``event_id % 97 = 0`` (no JSON, empty, blank or null)); the oracles rebuild the expected rows
from the readings view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.metrics import get_key, metric_of, topic_matches
from ..operators import ingest as I
from ..sources import fixtures as X
from .catalog import query
from .common import AS_OF
from .oracle_views import with_views

TYPE_SQL = ("CASE WHEN event_id % 25 = 7 THEN 'HKQuantityTypeIdentifierRestingHeartRate' ELSE CASE metric "
            + " ".join(f"WHEN '{m}' THEN '{t}'" for t, m in C.METRIC_BY_TYPE.items()) + " END END")
METRIC_SQL = "CASE WHEN event_id % 25 = 7 THEN 'unknown' ELSE metric END"
ISO_SQL = "strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f+00:00')"
GOOD = "event_id % 97 <> 0"
INGESTED = "'2024-01-31T00:00:00+00:00'"
DEVICE_PREFIX = C.DEVICE_TOPIC_PREFIX


def _messages(spark, root):
    return X.wire(spark, root)


def _parsed(spark, root):
    good, _ = I.split_malformed(I.parse_payload(_messages(spark, root)))
    return good


def _records(spark, root):
    records, _ = I.bridge(_messages(spark, root), now=AS_OF)
    return records


@query("p10_encode_readings", with_views(f"""
SELECT event_id, '{{"user_id":' || user_id || ',"type":"' || ({TYPE_SQL.replace('event_id % 25 = 7', 'false')})
  || '","unit":"' || unit || '","value":' || CAST(value AS VARCHAR)
  || ',"start_date":"' || {ISO_SQL} || '","end_date":"' || {ISO_SQL} || '"'
  || CASE WHEN source_name IS NULL THEN '' ELSE ',"source_name":"' || source_name || '"' END
  || ',"device":"wrist-sensor"'
  || CASE WHEN phase IS NULL THEN '' ELSE ',"metadata":{{"phase":"' || phase || '"}}' END || '}}' AS json
FROM readings
""", "readings"))
def p10_encode_readings(spark, root):
    """P10: each reading as a JSON document, null fields (metadata too) omitted."""
    return I.encode_readings(X.readings(spark, root), now=AS_OF, keep=["event_id"])


@query("p8_topic_of", with_views(f"""
SELECT event_id AS offset, '{DEVICE_PREFIX}/' || {METRIC_SQL} AS topic FROM readings
""", "readings"))
def p8_topic_of(spark, root):
    """Device publishing topic per reading type, '/unknown' for unmapped types."""
    return _messages(spark, root).select("offset", "topic")


@query("p6_topic_matches", with_views(f"""
SELECT event_id AS offset, true AS one_level, false AS too_shallow, true AS multi_level,
       {METRIC_SQL} = 'heart_rate' AS hr_only
FROM readings
""", "readings"))
def p6_topic_matches(spark, root):
    """MQTT-style topic filters ('+' one level, '#' the rest) over device topics."""
    m = _messages(spark, root)
    return m.select(
        "offset",
        topic_matches("topic", f"{DEVICE_PREFIX}/+").alias("one_level"),
        topic_matches("topic", "wearable/+").alias("too_shallow"),
        topic_matches("topic", "wearable/#").alias("multi_level"),
        topic_matches("topic", f"{DEVICE_PREFIX}/heart_rate").alias("hr_only"))


@query("p5_quarantine", with_views(f"""
SELECT event_id AS offset, CASE event_id // 97 % 4 WHEN 0 THEN 'not json' WHEN 1 THEN '' WHEN 2 THEN '  ' END AS payload
FROM readings WHERE NOT ({GOOD})
""", "readings"))
def p5_quarantine(spark, root):
    """Unreadable payloads (no JSON, empty, blank, missing) split off to a quarantine output."""
    _, bad = I.split_malformed(I.parse_payload(_messages(spark, root)))
    return bad.select("offset", "payload")


@query("p1_metric_of", with_views(f"""
SELECT event_id AS offset, {TYPE_SQL} AS type, {METRIC_SQL} AS metric FROM readings WHERE {GOOD}
""", "readings"))
def p1_metric_of(spark, root):
    """Type -> metric through the fixed map, 'unknown' otherwise."""
    return _parsed(spark, root).select("offset", "type", metric_of(F.col("type")).alias("metric"))


@query("p2_enrich", with_views(f"""
SELECT event_id AS offset, {METRIC_SQL} AS metric, {INGESTED} AS ingested_at,
       '{DEVICE_PREFIX}/' || {METRIC_SQL} AS source_topic, '{C.BRIDGE_TAG}' AS bridge
FROM readings WHERE {GOOD}
""", "readings"))
def p2_enrich(spark, root):
    """Metric overwritten, ingest time (fixed clock), source topic and bridge tag added."""
    return I.enrich(_parsed(spark, root), now=AS_OF).select(
        "offset", "metric", "ingested_at", "source_topic", "bridge")


@query("p3_route_topic", with_views(f"""
SELECT event_id AS offset, 'biometrics.' || {METRIC_SQL} AS topic FROM readings WHERE {GOOD}
""", "readings"))
def p3_route_topic(spark, root):
    """Broker topic 'biometrics.<metric>'."""
    return _records(spark, root).select("offset", "topic")


@query("p4_route_key", with_views(f"""
SELECT event_id AS offset, coalesce(CAST(user_id AS VARCHAR), 'anonymous') AS key FROM readings WHERE {GOOD}
""", "readings"))
def p4_route_key(spark, root):
    """Partition key = user id text, 'anonymous' when absent."""
    return _records(spark, root).select("offset", "key")


@query("p7_monitor_view", with_views(f"""
SELECT '{DEVICE_PREFIX}/' || {METRIC_SQL} AS topic, {METRIC_SQL} AS metric, {TYPE_SQL} AS type, value, user_id,
       unit, phase, {ISO_SQL} AS ts
FROM readings WHERE {GOOD}
""", "readings"))
def p7_monitor_view(spark, root):
    """Monitor projection (metric = last topic level) of parsed device messages."""
    return I.monitor_view(_parsed(spark, root))


@query("p9_ingest_counts", with_views(f"""
SELECT coalesce(metric, 'total') AS metric, count(*) AS n
FROM (SELECT {METRIC_SQL} AS metric FROM readings WHERE {GOOD}) t GROUP BY ROLLUP (metric)
""", "readings"))
def p9_ingest_counts(spark, root):
    """Readings forwarded per metric plus the total."""
    return I.ingest_counts(_records(spark, root))


@query("s2_decode", with_views(f"""
SELECT event_id AS offset, user_id, {TYPE_SQL} AS type, unit, value, {ISO_SQL} AS start_date,
       {METRIC_SQL} AS metric, {INGESTED} AS ingested_at, phase, 'biometrics.' || {METRIC_SQL} AS kafka_topic,
       event_time
FROM readings WHERE {GOOD}
""", "readings"))
def s2_decode(spark, root):
    """Broker records (bridge output) decoded with the fixed schema, topic kept."""
    d = I.decode(_records(spark, root).drop("metric"))
    return d.select("offset", "user_id", "type", "unit", "value", "start_date", "metric", "ingested_at",
                    get_key("metadata", "phase").alias("phase"), "kafka_topic", "event_time")


@query("s3_event_time", with_views(f"""
SELECT event_id AS offset, {ISO_SQL} AS start_date, event_time FROM readings WHERE {GOOD}
""", "readings"))
def s3_event_time(spark, root):
    """S3: event time parsed from the ISO start date (null on bad text)."""
    return I.decode_marked(_records(spark, root).drop("metric")).select("offset", "start_date", "event_time")

