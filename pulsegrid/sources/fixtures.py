"""Adapter views: the driver's test tables presented in the shapes the jobs read.

These only rename and recode columns of the given tables (see FIXTURES.md);
they do none of the jobs' work.  Each has a DuckDB twin in
``pulsegrid.plans.oracle_views`` so oracles start from the same rows.

* ``readings``      decoded readings (from ``events``)
* ``users``         user dimension (from ``customer``)
* ``contact_links`` contact-id updates with a sequence number (from ``orders``; a few name users that do not exist)
* ``journal``       journal entries with a sequence number (from ``orders``)
* ``chat_turns``    chat messages (from ``conversations``)
* ``survey``        sleep survey rows (from ``customer``)
* ``wire``          device messages: topic and JSON payload (readings encoded
                    by P10; a resting-heart-rate type and a non-JSON payload
                    are mixed in so the unmapped and malformed paths run)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .tables import read_table

# A fixed clock for "now" in tests and registered queries (events run
# 2024-01-01 .. 2024-01-30).
AS_OF = "2024-01-31 00:00:00"

# ISO-8601 text with offset, as devices send it.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"

_TYPE_BY_METRIC = {metric: hk for hk, metric in C.METRIC_BY_TYPE.items()}


def _sql_case(expr: str, mapping: dict, default) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else str(x)
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {lit(default)} END"


def readings(spark: SparkSession, root: str) -> DataFrame:
    """Decoded readings (the schema ``decode`` produces) from ``events``."""
    ev = read_table(spark, root, "events")
    metric = _sql_case("event_type", {"click": "heart_rate", "view": "hrv", "error": "oxygen",
                                      "purchase": "temperature"}, "respiration")
    unit = _sql_case("event_type", {"view": C.UNIT_MS, "error": C.UNIT_PERCENT, "purchase": C.UNIT_CELSIUS},
                     C.UNIT_BPM)
    stage = _sql_case("k % 5", {0: "Awake", 1: "InBed", 2: "AsleepCore", 3: "AsleepDeep"}, "AsleepREM")
    base = ev.selectExpr(
        "*", "try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k").selectExpr(
        "event_id", "user_id", "CAST(ts AS TIMESTAMP) AS event_time", f"{metric} AS metric",
        "CASE event_type WHEN 'click' THEN 50 + value / 2 WHEN 'view' THEN 10 + value "
        "WHEN 'error' THEN 100 - value / 10 WHEN 'purchase' THEN 35 + value / 40 ELSE 10 + value / 10 END AS value",
        f"{unit} AS unit",
        f"CASE WHEN k >= 95 THEN CAST(NULL AS STRING) ELSE concat('{C.STAGE_PREFIX}', {stage}) END AS phase")
    iso = f"date_format(event_time, \"{ISO_FORMAT}\")"
    return base.selectExpr(
        "event_id", "user_id", f"{_sql_case('metric', _TYPE_BY_METRIC, C.UNKNOWN_METRIC)} AS type",
        "unit", "value", f"{iso} AS start_date", f"{iso} AS end_date",
        "CASE WHEN phase IS NOT NULL THEN 'watch-sim' END AS source_name",
        "'wrist-sensor' AS device", "metric", "CAST(NULL AS STRING) AS ingested_at",
        "CASE WHEN phase IS NOT NULL THEN map('phase', phase) END AS metadata",
        "event_time")


def users(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "customer")
    return c.selectExpr(
        "c_custkey AS user_id", "concat(lower(c_name), '@example.org') AS email", "c_name AS name",
        "CASE c_nationkey % 3 WHEN 0 THEN 'morning' WHEN 1 THEN 'evening' ELSE 'intermediate' END AS chronotype",
        "'Europe/Madrid' AS timezone",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('chat-', CAST(c_custkey AS STRING)) END AS contact_id")


def contact_links(spark: SparkSession, root: str) -> DataFrame:
    o = read_table(spark, root, "orders")
    return o.selectExpr("o_orderkey AS seq", "o_custkey + o_orderkey % 3 AS user_id",
                        "concat('new-', CAST(o_orderkey AS STRING)) AS contact_id")


def journal(spark: SparkSession, root: str) -> DataFrame:
    o = read_table(spark, root, "orders")
    return o.selectExpr(
        "o_orderkey AS seq", "o_custkey AS user_id",
        "CAST(date_trunc('month', o_orderdate) AS DATE) AS entry_date",
        "CASE WHEN o_orderkey % 53 = 0 THEN 11 ELSE CAST(1 + o_orderkey % 10 AS INT) END AS mood",
        "CAST(1 + o_custkey % 10 AS INT) AS stress_level",
        "o_orderstatus = 'F' AS caffeine_after_17", "o_orderstatus = 'O' AS alcohol",
        "CAST(CAST(floor(o_totalprice) AS BIGINT) % 700 AS INT) AS screens_min_before_bed",
        "o_orderpriority AS notes", "CAST(o_orderdate AS TIMESTAMP) AS created_at")


def chat_turns(spark: SparkSession, root: str) -> DataFrame:
    cv = read_table(spark, root, "conversations")
    return cv.selectExpr(
        "conv_id", "turn", "conv_id % 15 AS user_id", "role", "text AS content",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, "
        "CAST(conv_id * 600 + turn AS DECIMAL(18, 6))) AS created_at")


def survey(spark: SparkSession, root: str) -> DataFrame:
    c = read_table(spark, root, "customer")
    return c.selectExpr(
        "c_custkey AS person_id", "CASE c_custkey % 2 WHEN 0 THEN 'Male' ELSE 'Female' END AS gender",
        "CAST(18 + c_custkey % 60 AS INT) AS age", "5 + (c_custkey % 36) / CAST(10 AS DOUBLE) AS sleep_duration",
        "CAST(30 + c_custkey % 61 AS INT) AS physical_activity", "CAST(1 + c_nationkey % 10 AS INT) AS stress_level",
        "CASE c_custkey % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Normal Weight' WHEN 2 THEN 'Overweight' "
        "ELSE 'Obese' END AS bmi_category",
        "concat(CAST(110 + c_custkey % 40 AS STRING), '/', CAST(70 + c_custkey % 25 AS STRING)) AS blood_pressure",
        "CAST(60 + c_nationkey AS INT) AS heart_rate",
        "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Insomnia' ELSE 'Sleep Apnea' END AS sleep_disorder",
    ).selectExpr(
        "*", "CAST(greatest(1, least(10, 10 - floor(stress_level / 2) + floor(sleep_duration - 6))) AS INT) "
        "AS quality_of_sleep")


def wire(spark: SparkSession, root: str, tasks: int | None = None, by_time: bool = False) -> DataFrame:
    """Device messages (offset, topic, payload, timestamp) built from readings.

    The payload is the P10 JSON encoding of a reading and the topic is P8's
    device topic.  Where ``event_id % 25 = 7`` the type is the unmapped
    resting-heart-rate identifier; where ``event_id % 97 = 0`` the payload is
    unreadable: no JSON, empty, blank or null.  This is the bridge's input (P1-P9).
    With ``tasks`` the readings are spread over so many before they are
    encoded: the table's few files are small, the messages are not.  ``by_time``
    gives each task a stretch of whole minutes, in their order (no time: last).
    """
    from ..functions.metrics import topic_of
    from ..operators.ingest import encode_readings

    r = readings(spark, root)
    if tasks:
        minute = F.date_trunc("minute", "event_time").asc_nulls_last()
        r = r.repartitionByRange(tasks, minute) if by_time else r.repartition(tasks, "event_id")
    r = r.withColumn(
        "type", F.when(F.col("event_id") % 25 == 7, F.lit(C.HK_RESTING_HEART_RATE)).otherwise(F.col("type")))
    enc = encode_readings(r, keep=["event_id", "event_time", "type"])
    return enc.select(
        F.col("event_id").alias("offset"),
        topic_of(F.col("type")).alias("topic"),
        F.when(F.col("event_id") % 97 == 0, F.expr("element_at(array('not json', '', '  ', null), "
                                                   "cast(event_id div 97 % 4 as int) + 1)"))
        .otherwise(F.col("json")).alias("payload"),
        F.col("event_time").alias("timestamp"),
    )
