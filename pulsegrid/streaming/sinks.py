"""Sinks (K1-K5, K10, K11): document projections and idempotent DataFrame writes (keyed tables: ``sources.keyed``).

Each sink is a projection (testable as a query) plus a writer.  Writers
let errors fail the batch instead of swallowing them (D4) and are
idempotent per micro-batch: a batch's rows go to the partition
``writer_id=<stream>/batch_id=<n>``, written in overwrite mode (dynamic
partition overwrite).  A replay after a crash rewrites its own partition; a
stream with another checkpoint is another writer and never touches it.
Nothing in a row depends on the clock of the replay.  Documents and rows carry
deterministic ids (D5), so readers and the compaction (``compaction``) keep one per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.metrics import get_key, route_key
from ..operators.ingest import iso_text


# ISO-8601 with microseconds and offset (session zone is UTC), as alert consumers parse it.
JSON_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


def _now(now) -> Column:
    if now is None:
        return F.current_timestamp()
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def _index(prefix: str, day: Column, now) -> Column:
    return F.concat(F.lit(prefix), F.date_format(day if now is None else _now(now), "yyyy-MM-dd"))


def _digest(*cols) -> Column:
    """A text id of the columns' values (null and empty told apart)."""
    return F.md5(F.to_json(F.struct(*cols)))


def reading_id(readings: DataFrame) -> Column:
    """The id of a reading: its event id where it has one (padded, so text sorts as the number), else a digest of its fields."""
    if "event_id" in readings.columns:
        text = F.col("event_id").cast("string")
        return F.when(text.rlike("^[0-9]{1,20}$"), F.lpad(text, 20, "0")).otherwise(text)
    fields = [c for c in ("user_id", "metric", "event_time", "value", "unit", "type", "end_date", "source_name", "device", "metadata")
              if c in readings.columns]
    return _digest(*fields)


def raw_docs(readings: DataFrame, now=None) -> DataFrame:
    """K1: raw reading documents, daily index by UTC ingest day, source defaults to 'simulator'.

    The day is a column of the record (ingest, broker or event time), so a
    replay on another day writes the same documents; ``now`` overrides it.
    """
    times = [F.to_date(F.try_to_timestamp("ingested_at"))]
    times += [F.to_date(c) for c in ("kafka_ts", "event_time") if c in readings.columns]
    return readings.select(
        _index("biometrics-", F.coalesce(*times), now).alias("index"), reading_id(readings).alias("doc_id"),
        F.col("start_date").alias("@timestamp"), "user_id", "metric", "value", "unit",
        get_key("metadata", "phase").alias("phase"),
        F.coalesce(F.col("source_name"), F.lit(C.DEFAULT_SOURCE)).alias("source"),
        "ingested_at")


def agg_docs(windows: DataFrame, now=None) -> DataFrame:
    """K2: window-aggregate documents keyed by (window start, user, metric), daily index by the window's day."""
    start = iso_text(F.col("window_start"))
    return windows.select(
        _index("biometrics-agg-", F.to_date("window_start"), now).alias("index"),
        F.concat_ws("|", start, F.col("user_id").cast("string"), F.col("metric")).alias("doc_id"),
        start.alias("@timestamp"), iso_text(F.col("window_end")).alias("window_end"),
        "user_id", "metric", "avg_value", "min_value", "max_value", "n_samples")


def reading_rows(readings: DataFrame) -> DataFrame:
    """K3: reading-history rows: time, user, metric, value, source, metadata as JSON text ('{}' if none), row id."""
    return readings.select(
        F.col("event_time").alias("time"), "user_id", "metric", "value",
        F.coalesce(F.col("source_name"), F.lit(C.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("metadata"), reading_id(readings).alias("row_id"),
        F.to_date("event_time").alias("event_date"))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """K4: alert-history rows; the non-core fields packed into a JSON column (nulls omitted), the reading's row id and rule position."""
    return alerts.select(
        "user_id", "created_at", "severity", "category", "title", "text",
        F.to_json(F.struct("metric", "value", "phase")).alias("metadata"), reading_id(alerts).alias("row_id"), "rule_pos",
        F.to_date("created_at").alias("event_date"))


ALERT_FIELDS = ("user_id", "created_at", "severity", "category", "title", "text", "metric", "value", "phase")


def alert_id() -> Column:
    """The id of an alert record, the same for every copy of it."""
    return _digest(*ALERT_FIELDS)


def alert_records(alerts: DataFrame) -> DataFrame:
    """K5: alert-topic records: key = user id text, value = the alert as JSON with its id, so consumers can tell copies."""
    body = F.struct(*ALERT_FIELDS, alert_id().alias("alert_id"))
    return alerts.select(route_key(F.col("user_id")).alias("key"), F.lit(C.ALERTS_TOPIC).alias("topic"),
                         F.to_json(body, {"timestampFormat": JSON_TIMESTAMP}).alias("value"))


def layout(df: DataFrame, date_col: str = "event_date", order: list[str] | None = None, time_col: str | None = None) -> DataFrame:
    """History layout: rows clustered by day, sorted (user, metric, time desc) within files.

    Range partitioning on (day, user, metric, time) gives each task a
    contiguous slice, so a day is written as few files per task, yet a big
    day, or one user holding a third of a day, is split over many tasks
    (the time column keeps equal keys rare).  The sort (day first, matching
    ``partitionBy``) gives Parquet row-group min/max stats that let
    user/metric predicates skip row groups, standing in for the row store's
    (user, metric, time desc) index.
    """
    order = order or ["user_id", "metric"]
    time_col = time_col or ("time" if "time" in df.columns else "event_time")
    return ranged(df, date_col, order, time_col).sortWithinPartitions(date_col, *order, F.col(time_col).desc())


def ranged(df: DataFrame, date_col: str, order: list[str], time_col: str) -> DataFrame:
    """Contiguous slices of (day, order, time), one a task."""
    return df.repartitionByRange(F.col(date_col), *[F.col(c) for c in order], F.col(time_col))


def write_batch(df: DataFrame, path: str, writer_id: str, batch_id: int, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Write one micro-batch: an idempotent overwrite of its own partition, no matter how often it is replayed.

    ``by`` puts columns (the day) above the writer and batch, so a later job
    lists and reads one day's batches only.  JSON is compressed: its field names
    and digests make most of its bytes.
    """
    marked = df.withColumns({"writer_id": F.lit(writer_id), "batch_id": F.lit(int(batch_id)).cast("bigint")})
    writer = marked.write.option("compression", "gzip") if fmt == "json" else marked.write
    (writer.format(fmt).option("partitionOverwriteMode", "dynamic").partitionBy(*by, "writer_id", "batch_id")
     .mode("overwrite").save(path))


def publish(records: DataFrame, cfg: dict, writer_id: str, batch_id: int) -> None:
    """K5 writer: Kafka when configured (needs the connector jar; at least once, copies share their alert id), else JSON files."""
    if cfg.get("format") == "kafka":
        (records.selectExpr("key", "value", "topic").write.format("kafka")
         .option("kafka.bootstrap.servers", cfg["bootstrap"]).save())
    else:
        write_batch(records, cfg["path"], writer_id, batch_id, fmt="json")


def prediction_rows(scored: DataFrame, model_version: str, now=None) -> DataFrame:
    """Prediction-history rows from M9 output (table declared but never written upstream)."""
    inputs = [c for c in C.NUMERIC_FEATURES + C.CATEGORICAL_FEATURES if c in scored.columns]
    return scored.select(
        F.col("person_id").alias("user_id"), _now(now).alias("predicted_at"),
        F.to_date(_now(now)).alias("target_date"), F.col("raw_value").alias("quality_raw"), "score_100",
        "category", F.lit(model_version).alias("model_version"),
        F.to_json(F.struct(*inputs)).alias("inputs"))


def latest_docs(docs: DataFrame, key: str = "doc_id", version: str = "batch_id") -> DataFrame:
    """D5 reader: an update-mode sink rewrites a window in later batches; keep the newest per key.

    A ``max(struct(version, row))`` aggregate, so the pick is map-side combined.
    """
    rest = [c for c in docs.columns if c not in (key, version, "writer_id")]
    agg = docs.groupBy(key).agg(F.max(F.struct(F.col(version).alias("_ver"), *rest)).alias("_l"))
    return agg.select(key, *[F.col(f"_l.{c}").alias(c) for c in rest], F.col("_l._ver").alias(version))
