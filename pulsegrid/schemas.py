"""Schemas declared at each edge (no inference on the hot path).

Wire and table field names are fixed values of the data model.
"""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT_COLUMN = "_corrupt_record"

# A reading as a device sends it (unknown extra fields are dropped by the schema).
DEVICE_READING = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_version", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

# A reading after the bridge (what the stream job decodes).
BROKER_READING = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("ingested_at", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

# A broker record as a file source carries it (the Kafka source's columns).
BROKER_RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

# A device message as a file source carries it.
DEVICE_MESSAGE = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Decoded reading as the batch and stream jobs see it.
DECODED_READING = T.StructType(BROKER_READING.fields + [
    T.StructField("kafka_topic", T.StringType()),
    T.StructField("kafka_ts", T.TimestampType()),
    T.StructField("event_time", T.TimestampType()),
])

# Alert as published on the alert topic.
ALERT = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("phase", T.StringType()),
])

# Survey CSV as published (headers with spaces); read with this schema.
SURVEY_CSV = T.StructType([
    T.StructField("Person ID", T.LongType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Occupation", T.StringType()),
    T.StructField("Sleep Duration", T.DoubleType()),
    T.StructField("Quality of Sleep", T.IntegerType()),
    T.StructField("Physical Activity Level", T.IntegerType()),
    T.StructField("Stress Level", T.IntegerType()),
    T.StructField("BMI Category", T.StringType()),
    T.StructField("Blood Pressure", T.StringType()),
    T.StructField("Heart Rate", T.IntegerType()),
    T.StructField("Daily Steps", T.IntegerType()),
    T.StructField("Sleep Disorder", T.StringType()),
])


def with_corrupt_column(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT_COLUMN, T.StringType())])


# ---------------------------------------------------------------------------
# Tables at rest (Parquet, day-partitioned where they grow with time).
# ---------------------------------------------------------------------------

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("email", T.StringType(), False),          # unique (J5)
    T.StructField("name", T.StringType()),
    T.StructField("chronotype", T.StringType()),             # morning | evening | intermediate
    T.StructField("timezone", T.StringType()),
    T.StructField("contact_id", T.StringType()),             # chat-channel id (K8)
    T.StructField("created_at", T.TimestampType()),
])

READING_ROWS = T.StructType([                                 # K3, partitioned by event_date
    T.StructField("time", T.TimestampType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("metadata", T.StringType()),               # JSON text
    T.StructField("row_id", T.StringType()),
    T.StructField("event_date", T.DateType()),
])

ALERT_ROWS = T.StructType([                                   # K4, partitioned by event_date
    T.StructField("user_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StringType()),               # JSON text of metric, value, phase
    T.StructField("row_id", T.StringType()),                 # of the reading
    T.StructField("rule_pos", T.IntegerType()),
    T.StructField("event_date", T.DateType()),
])

CHAT_MESSAGES = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("role", T.StringType(), False),            # user | assistant | system
    T.StructField("content", T.StringType(), False),
    T.StructField("session_id", T.StringType()),
    T.StructField("row_id", T.StringType()),
])

JOURNAL = T.StructType([                                      # unique (user_id, entry_date) after K7
    T.StructField("seq", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("entry_date", T.DateType(), False),
    T.StructField("mood", T.IntegerType()),
    T.StructField("stress_level", T.IntegerType()),
    T.StructField("caffeine_after_17", T.BooleanType()),
    T.StructField("alcohol", T.BooleanType()),
    T.StructField("screens_min_before_bed", T.IntegerType()),
    T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

PREDICTIONS = T.StructType([                                  # K11
    T.StructField("user_id", T.LongType(), False),
    T.StructField("predicted_at", T.TimestampType(), False),
    T.StructField("target_date", T.DateType(), False),
    T.StructField("quality_raw", T.DoubleType()),
    T.StructField("score_100", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("inputs", T.StringType()),                  # JSON text
])
