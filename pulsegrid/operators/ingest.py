"""Ingest: the device-to-broker bridge and the stream decoder as DataFrame steps.

The bridge (P1-P9) parses device payloads, quarantines the unparseable ones,
maps type -> metric, enriches and routes each reading.  The decoder (S2, S3)
turns broker records back into typed readings with an event time.  All steps
are per-row projections/filters, so they run map-side with no shuffle, on
batch and streaming frames alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas as S
from ..functions.metrics import get_key, last_segment, metric_of, route_key, route_topic

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def _now(now) -> Column:
    if now is None:
        return F.current_timestamp()
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def iso_text(ts: Column) -> Column:
    """Timestamp -> ISO-8601 text with offset (session zone is UTC), like Python's ``isoformat()``:
    microseconds are written only when they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(F.date_format(ts, ISO_FORMAT))


def encode_readings(df: DataFrame, now=None, keep: list[str] | None = None) -> DataFrame:
    """P10: one JSON document per reading in column ``json``.

    Null fields, metadata included, are omitted; a missing start or end date
    defaults to ``now``.  ``keep`` columns are carried alongside.
    """
    now_text = iso_text(_now(now))
    fields = [F.col("user_id"), F.col("type"), F.col("unit"), F.col("value"),
              F.coalesce(F.col("start_date"), now_text).alias("start_date"),
              F.coalesce(F.col("end_date"), now_text).alias("end_date")]
    for name in ("source_name", "source_version", "device", "metadata"):
        if name in df.columns:
            fields.append(F.col(name))
    return df.select(*(keep or []), F.to_json(F.struct(*fields)).alias("json"))


def _parsed(text, schema, others: list, df: DataFrame) -> DataFrame:
    """``others``, then the fields of ``schema`` and the corrupt-record text (not null: unreadable).

    The struct goes through a generator (``inline``): a filter on the parsed
    fields cannot be pushed below it, so each text is parsed once instead of
    once per consumer.  Unreadable are: text that is no JSON object of the
    schema, the JSON null, and empty, blank or missing text.
    """
    t = text.cast("string")
    parsed = F.from_json(t, S.with_corrupt_column(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT_COLUMN})
    rows = df.select(*others, F.inline(F.array(F.struct(t.alias("_t"), parsed.alias("_r")))))
    unreadable = F.col("_r").isNull() | (F.trim(F.coalesce("_t", F.lit(""))) == "")
    corrupt = F.when(unreadable, F.coalesce("_t", F.lit(""))).otherwise(F.col(f"_r.{S.CORRUPT_COLUMN}"))
    return rows.select("*", *[F.col(f"_r.{f}").alias(f) for f in schema.fieldNames()], corrupt.alias(S.CORRUPT_COLUMN)).drop("_r")


def parse_payload(df: DataFrame, payload: str = "payload",
                  schema=S.DEVICE_READING) -> DataFrame:
    """Parse a JSON text column into ``schema`` columns plus ``_corrupt_record`` (null for readable payloads)."""
    others = [c for c in df.columns if c != payload]
    return _parsed(F.col(payload), schema, others, df).withColumnRenamed("_t", payload)


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) from a ``parse_payload`` result."""
    bad_flag = F.col(S.CORRUPT_COLUMN).isNotNull()
    return parsed.where(~bad_flag).drop(S.CORRUPT_COLUMN), parsed.where(bad_flag)


def enrich(df: DataFrame, now=None, topic_col: str = "topic") -> DataFrame:
    """P1 + P2: overwrite ``metric`` from the type, stamp ingest time, source topic, bridge tag."""
    return df.withColumns({
        "metric": metric_of(F.col("type")),
        "ingested_at": iso_text(_now(now)),
        "source_topic": F.col(topic_col),
        "bridge": F.lit(C.BRIDGE_TAG),
    })


BRIDGE_FIELDS = ("metric", "ingested_at", "source_topic", "bridge")
# one object, at most one more inside a value, strings without escapes: its last brace closes it
_PLAIN = r"""(?:[^{}"\\]++|"[^"\\]*+")*+"""
PLAIN_OBJECT = rf"^\s*\{{{_PLAIN}(?:\{{{_PLAIN}\}}{_PLAIN})*+\}}\s*$"
PLAIN_CHARS = 4096  # longer texts go the other way (the pattern needs stack for each string in a text)


def _put_in(payload: Column) -> Column:
    """The payload's text with the bridge fields put in before its last brace; null where that can't be done by text alone."""
    names = [payload.contains(f'"{n}"') for n in BRIDGE_FIELDS]
    plain = (F.length(payload) <= PLAIN_CHARS) & ~reduce(lambda a, b: a | b, names) & payload.rlike(PLAIN_OBJECT) & ~payload.rlike(r"^\s*\{\s*\}")
    body = F.regexp_replace(payload, r"\}\s*$", ",")
    return F.when(plain, F.concat(body, F.substring(F.to_json(F.struct(*BRIDGE_FIELDS)), 2, 1 << 30)))


def bridge(messages: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """Device messages (topic, payload, ...) -> (broker records, quarantine).

    Broker records carry ``key`` (P4), ``topic`` (P3) and the JSON ``value``:
    the device's object as it came, unknown fields too, with the four bridge
    fields put in; a Kafka or file sink writes them as they are.  A plain
    payload is parsed once and gets the fields as text; one that has such a
    field already, escapes or deeper objects is rebuilt by the variant parser.
    """
    good, bad = split_malformed(parse_payload(messages, "payload"))
    extra = [c for c in messages.columns if c not in ("topic", "payload")]
    return _to_broker(good, extra, now), bad


def bridge_all(messages: DataFrame, now=None) -> DataFrame:
    """Both sides of ``bridge`` in one pass, parsed once and in the order they came: the broker records, and the unreadable
    payloads as the values of records without a user and of an unknown topic."""
    parsed = parse_payload(messages, "payload")
    extra = [c for c in messages.columns if c not in ("topic", "payload")]
    kept = [F.col("payload").alias("_p"), F.col(S.CORRUPT_COLUMN).isNull().alias("_good")]
    records = _to_broker(parsed, [*extra, *kept], now)
    as_came = {"key": F.lit(C.ANONYMOUS_KEY), "value": F.col("_p"), "topic": route_topic(F.lit(C.UNKNOWN_METRIC))}
    return records.select(*extra, *[F.when(F.col("_good"), F.col(c)).otherwise(v).alias(c) for c, v in as_came.items()])


def _to_broker(good: DataFrame, extra: list, now) -> DataFrame:
    enriched = enrich(good, now=now)
    names = ", ".join(f"'{n}'" for n in BRIDGE_FIELDS)
    added = ", ".join(f"'{n}', cast({n} as variant)" for n in BRIDGE_FIELDS)
    whole = F.expr("to_json(map_concat(map_filter(try_cast(try_parse_json(payload) as map<string, variant>), "
                   f"(k, v) -> k not in ({names})), map({added})))")
    # an object that the variant parser refuses (say, a field named twice) passes its known fields
    known = F.to_json(F.struct(*S.DEVICE_READING.fieldNames(), *BRIDGE_FIELDS))
    return enriched.select(
        *extra,
        route_key(F.col("user_id")).alias("key"),
        route_topic(F.col("metric")).alias("topic"),
        F.coalesce(_put_in(F.col("payload")), whole, known).alias("value"),
        "metric",
    )


def decode_marked(records: DataFrame, schema=S.BROKER_READING) -> DataFrame:
    """S2 + S3: broker records (value, topic, timestamp) -> typed readings, with ``raw`` and ``reason``.

    The value is decoded with a fixed schema (unknown fields dropped); the
    event time is the parsed ``start_date`` (null on bad text, D3).  ``raw`` is
    the value as it came and ``reason`` says why a row cannot go into the
    history (null: it can).
    """
    others = [c for c in records.columns if c not in ("value", "topic", "timestamp", "key")]
    head = [*others, F.col("topic").alias("kafka_topic"), F.col("timestamp").cast("timestamp").alias("kafka_ts")]
    d = _parsed(F.col("value"), schema, head, records).withColumnRenamed("_t", "raw")
    d = d.withColumn("event_time", F.try_to_timestamp(F.col("start_date")))
    reason = F.when(F.col(S.CORRUPT_COLUMN).isNotNull(), "unreadable").otherwise(missing_field())
    return d.select(*others, *schema.fieldNames(), "kafka_topic", "kafka_ts", "event_time", "raw", reason.alias("reason"))


def missing_field():
    """Which of the fields that a stored reading must have is null, if one is."""
    return (F.when(F.col("user_id").isNull(), "no user").when(F.col("metric").isNull(), "no metric")
            .when(F.col("event_time").isNull(), "no time"))


def mark_incomplete(readings: DataFrame) -> DataFrame:
    """Decoded readings with ``raw`` (the row as JSON) and ``reason``, as ``decode_marked`` gives them."""
    return readings.withColumns({"raw": F.to_json(F.struct(*readings.columns)), "reason": missing_field()})


def decode(records: DataFrame, schema=S.BROKER_READING) -> DataFrame:
    """The readings of ``decode_marked`` that are complete."""
    return decode_marked(records, schema).where(F.col("reason").isNull()).drop("raw", "reason")


def monitor_view(parsed: DataFrame, topic_col: str = "topic") -> DataFrame:
    """Flat monitor projection of parsed device messages."""
    return parsed.select(
        F.col(topic_col).alias("topic"),
        last_segment(F.col(topic_col)).alias("metric"),
        "type", "value", "user_id", "unit",
        get_key(F.col("metadata"), "phase").alias("phase"),
        F.col("start_date").alias("ts"),
    )


def ingest_counts(records: DataFrame, total_label: str = "total") -> DataFrame:
    """Readings forwarded per metric plus the running total.

    ``rollup`` gives both in one aggregation (partial aggregation map-side);
    on a stream, run it in complete mode and let the trigger replace the
    "every 50 messages" report.  The total is told by its grouping id, so
    readings without a metric stay a (null) metric of their own.
    """
    counts = records.rollup("metric").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return counts.select(F.when(F.col("g") == 1, F.lit(total_label)).otherwise(F.col("metric")).alias("metric"), "n")
