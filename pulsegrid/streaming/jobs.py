"""Structured Streaming jobs (S1, S4, W1-W6, K6): readings, window aggregates, the device bridge, alert delivery.

Same DataFrame functions as the batch queries.  Sources and sinks are
chosen by config: Kafka in production (the connector jar must be on the
classpath; none ships with this image, so that path is untested here) or
files (JSON/Parquet directories) for tests and file-drop ingestion.

Checkpoints live under the session's ``spark.checkpoint.dir`` unless a
location is given, so a restarted query resumes where it stopped (W5).
The shuffle width of a stateful query is fixed by its first checkpoint:
set ``spark.sql.shuffle.partitions`` for the production cluster before the
first start.
"""

from __future__ import annotations

import os
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from .. import schemas as S
from ..functions.metrics import topic_matches
from ..operators.aggregates import dispatch_stats, flatten_window, window_agg
from ..operators.ingest import bridge, decode_marked, mark_incomplete
from ..operators.joins import route_alerts
from ..operators.render import alert_message
from ..operators.rules import detect_alerts, hr_watch
from ..session import DEFAULT_CONF, checkpoint_root, ensure_utc
from ..sources import topics as T
from ..sources.tables import path_exists, read_table
from . import sinks as K
from .watch import early_watch


@dataclass
class StreamConfig:
    """Where readings come from and where results go."""
    source_format: str = "json"             # "kafka" | "topics" | "records" | "json" | "parquet"
    source_path: str | None = None           # file sources
    bootstrap: str | None = None             # kafka
    topic_pattern: str = C.STREAM_TOPIC_PATTERN
    starting_offsets: str = "latest"         # kafka and topics: where a new checkpoint begins
    max_files_per_trigger: int | None = None
    max_offsets_per_trigger: int | None = 1_000_000  # kafka: bounds the batch that follows an outage
    out_root: str | None = None              # sinks (files); default under the checkpoint root
    checkpoint: str | None = None            # default under the checkpoint root
    raw_trigger: str | None = C.RAW_TRIGGER
    agg_trigger: str | None = C.AGG_TRIGGER
    available_now: bool = False              # tests: drain what is there, then stop
    state_tasks: int | None = None           # shuffle width of a new checkpoint (default: the session's)
    state_batches: int | None = None         # batches that a checkpoint can go back to (default: the session's)
    state_heap: bool = False                 # windows in the executors' heap: faster, where the size of a batch bounds them
    watermark: str = C.WATERMARK_DELAY
    agg_mode: str = "update"                 # "update" (reference) or "append" (final windows)
    dedup: bool = True                       # windows and watches count a record sent twice once
    alerts_cfg: dict = field(default_factory=dict)
    device_path: str | None = None           # device messages as JSON files (topic, payload, timestamp): runs the bridge
    alerts_path: str | None = None           # alert records as JSON files: runs the delivery
    users_root: str | None = None            # where the delivery reads the users table

    def ckpt(self, spark: SparkSession, name: str) -> str:
        return os.path.join(self.checkpoint or os.path.join(checkpoint_root(spark), "pulsegrid-streams"), name)

    def out(self, spark: SparkSession, name: str) -> str:
        return os.path.join(self.out_root or os.path.join(checkpoint_root(spark), "pulsegrid-out"), name)

    def writer_id(self, spark: SparkSession, name: str) -> str:
        """The id that the stream's checkpoint keeps over restarts; another checkpoint has another one."""
        meta = os.path.join(self.ckpt(spark, name), "metadata")
        if not path_exists(spark, meta):  # a batch run by hand, outside a stream
            return f"{name}-manual"
        return spark.read.text(meta).select(F.get_json_object("value", "$.id")).first()[0]


def _kafka(spark: SparkSession, cfg: StreamConfig):
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", cfg.bootstrap)
              .option("startingOffsets", cfg.starting_offsets).option("failOnDataLoss", "false"))
    return reader.option("maxOffsetsPerTrigger", cfg.max_offsets_per_trigger) if cfg.max_offsets_per_trigger else reader


def _topics(spark: SparkSession, cfg: StreamConfig, path: str | None, option: str, topics: str) -> DataFrame:
    """Topic logs in files (``sources.topics``), with the columns of a Kafka source."""
    T.register(spark)
    reader = spark.readStream.format(T.FORMAT).option("path", path).option("startingOffsets", cfg.starting_offsets)
    return reader.option(option, topics).load()


def _files(spark: SparkSession, cfg: StreamConfig, schema):
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", cfg.max_files_per_trigger) if cfg.max_files_per_trigger else reader


def read_marked(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """S1 + S2 + S3: the decoded reading stream, with ``raw`` and ``reason`` (not null: to quarantine).

    Kafka: every topic matching ``biometrics\\..*`` from the latest offset,
    tolerating data loss, at most ``max_offsets_per_trigger`` a batch.  ``topics``:
    the same contract over topic logs in files (``sources.topics``).  Files:
    ``records`` = JSON lines of broker records (key, topic, value, timestamp),
    decoded like Kafka values; ``json`` / ``parquet`` = already decoded readings.
    """
    ensure_utc(spark)
    if cfg.source_format == "kafka":
        raw = _kafka(spark, cfg).option("subscribePattern", cfg.topic_pattern).load()
        return decode_marked(raw.select("key", "value", "topic", "timestamp"))
    if cfg.source_format == "topics":
        raw = _topics(spark, cfg, cfg.source_path, "subscribePattern", cfg.topic_pattern)
        return decode_marked(raw.select("key", "value", "topic", "timestamp"))
    if cfg.source_format == "records":
        return decode_marked(_files(spark, cfg, S.BROKER_RECORD).json(cfg.source_path))
    return mark_incomplete(_files(spark, cfg, S.DECODED_READING).format(cfg.source_format).load(cfg.source_path))


def read_readings(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """The complete readings of ``read_marked``."""
    return read_marked(spark, cfg).where(F.col("reason").isNull()).drop("raw", "reason")


def read_alerts(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """Alert stream: JSON alerts from ``alerts.detected`` (latest offset) or from files."""
    ensure_utc(spark)
    if cfg.source_format == "kafka":
        raw = _kafka(spark, cfg).option("subscribe", C.ALERTS_TOPIC).load()
        return raw.select(F.inline(F.array(F.from_json(F.col("value").cast("string"), S.ALERT))))
    if cfg.source_format == "topics":
        raw = _topics(spark, cfg, cfg.alerts_path or cfg.source_path, "subscribe", C.ALERTS_TOPIC)
        return raw.select(F.inline(F.array(F.from_json("value", S.ALERT))))
    return _files(spark, cfg, S.ALERT).json(cfg.alerts_path or cfg.source_path)


def read_alert_records(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """S4 from record files, as the K5 sink publishes them (key, topic, value)."""
    ensure_utc(spark)
    raw = _files(spark, cfg, "key string, topic string, value string").json(cfg.alerts_path)
    return raw.select(F.inline(F.array(F.from_json("value", S.ALERT))))


def read_device_messages(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """The bridge's input from files: topic, payload, timestamp."""
    ensure_utc(spark)
    return _files(spark, cfg, S.DEVICE_MESSAGE).json(cfg.device_path)


def with_watermark(df: DataFrame, delay: str = C.WATERMARK_DELAY, time_col: str = "event_time") -> DataFrame:
    """Event-time watermark (the column must be TIMESTAMP, not TIMESTAMP_NTZ)."""
    return df.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)


def once(df: DataFrame, cfg: StreamConfig, metric: str | None = None) -> DataFrame:
    """Readings under the watermark, each counted once: a record sent again within the watermark's delay is known by its id.

    State: an id a reading, for as long as the watermark allows a copy.  With
    ``metric`` only its readings are kept and known; the watermark is that of
    all (the condition names the time, so it stays above the watermark).
    """
    marked = with_watermark(df, cfg.watermark)
    if metric:
        marked = marked.where(F.when(F.col("event_time").isNotNull(), F.col("metric") == metric))
    if not cfg.dedup:
        return marked
    return marked.withColumn("_reading", K.reading_id(marked)).dropDuplicatesWithinWatermark(["_reading"]).drop("_reading")


def windowed(df: DataFrame, cfg: StreamConfig) -> DataFrame:
    """A1 + A2 under the watermark (W1, W2: late rows dropped, state evicted)."""
    return flatten_window(window_agg(once(df, cfg)))


def process_batch(spark: SparkSession, cfg: StreamConfig, name: str = "raw"):
    """K6: micro-batch fan-out: quarantine, raw documents, history rows and rule alerts.

    The batch is persisted once, with the readings' ids and the text of
    unreadable records only, and written by DataFrame writers (no collect); an
    empty batch writes nothing.  Every write goes to the stream's
    and batch's own partition, so a replayed batch overwrites its own output.
    History rows land by day, writer and batch; ``compaction.compact`` merges them into the history.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if "reason" not in batch.columns:
            batch = mark_incomplete(batch)
        complete = F.col("reason").isNull()
        batch = batch.withColumns({"event_id": F.when(complete, K.reading_id(batch)), "raw": F.when(~complete, F.col("raw"))}).persist()
        try:
            if batch.isEmpty():
                return
            writer = cfg.writer_id(spark, name)

            def put(df: DataFrame, table: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
                K.write_batch(df, cfg.out(spark, table), writer, batch_id, fmt, by)

            good = batch.where(complete).drop("raw", "reason")
            put(batch.where(F.col("reason").isNotNull()).select(
                "reason", "raw", *[c for c in ("kafka_topic", "kafka_ts") if c in batch.columns]), "quarantine", "json")
            put(K.raw_docs(good), "raw_docs", "json")
            put(K.reading_rows(good), "readings", by=("event_date",))
            alerts = detect_alerts(good, created_at=F.col("event_time"), keep=["event_id", "event_time"]).persist()
            try:
                put(K.alert_rows(alerts), "alerts", by=("event_date",))
                K.publish(K.alert_records(alerts), cfg.alerts_cfg or {"path": cfg.out(spark, "alerts_topic")}, writer, batch_id)
            finally:
                alerts.unpersist()
        finally:
            batch.unpersist()
    return run


def agg_batch(spark: SparkSession, cfg: StreamConfig, name: str = "agg"):
    """K2 per micro-batch: window documents, written idempotently by batch id."""
    def run(batch: DataFrame, batch_id: int) -> None:
        K.write_batch(K.agg_docs(batch), cfg.out(spark, "agg_docs"), cfg.writer_id(spark, name), batch_id, "json")
    return run


def bridge_batch(spark: SparkSession, cfg: StreamConfig, name: str = "bridge"):
    """P1-P6, P9 per micro-batch: device messages on the device topics -> broker records, quarantine, counts per metric."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.where(topic_matches("topic", f"{C.DEVICE_TOPIC_PREFIX}/+")).persist()
        try:
            if batch.isEmpty():
                return
            writer = cfg.writer_id(spark, name)
            # the ingest stamp is the message's own time: a replay writes the same records
            records, bad = bridge(batch, now=F.col("timestamp"))
            K.write_batch(records.select("key", "value", "topic", "timestamp"), cfg.out(spark, "broker"), writer, batch_id, "json")
            K.write_batch(bad.select("topic", F.col(S.CORRUPT_COLUMN).alias("raw"), "timestamp"), cfg.out(spark, "bridge_quarantine"),
                          writer, batch_id, "json")
            K.write_batch(records.groupBy("metric").agg(F.count(F.lit(1)).alias("n")), cfg.out(spark, "bridge_counts"), writer, batch_id)
        finally:
            batch.unpersist()
    return run


def bridge_totals(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """Messages forwarded so far, per metric and in total."""
    counts = spark.read.parquet(cfg.out(spark, "bridge_counts")).rollup("metric").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    return counts.select(F.when(F.col("g") == 1, F.lit("total")).otherwise(F.col("metric")).alias("metric"), "n")


def deliver_batch(spark: SparkSession, cfg: StreamConfig, users, name: str = "delivery"):
    """S4 -> J1 -> F1 per micro-batch: an outbox row for each alert and channel, and the A16 counters.

    Every alert with a user goes to the live channel, and to the chat channel
    if the user has a contact id.  ``users()`` gives the user table as it is at
    the batch.  The outbox id is the alert's id and channel.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            writer = cfg.writer_id(spark, name)
            routed = route_alerts(batch, users(), "left")
            text = routed.withColumns({"alert_id": K.alert_id(), "message": alert_message(routed)})
            channels = F.array_compact(F.array(F.lit("live"), F.when(F.col("contact_id").isNotNull(), F.lit("chat"))))
            rows = text.withColumn("channel", F.explode(channels)).select(
                F.concat_ws("-", "alert_id", "channel").alias("outbox_id"), "alert_id", "channel", "user_id",
                F.when(F.col("channel") == "chat", F.col("contact_id")).alias("contact_id"), "severity", "message", "created_at")
            K.write_batch(rows, cfg.out(spark, "outbox"), writer, batch_id)
            K.write_batch(dispatch_stats(batch, routed), cfg.out(spark, "dispatch_counts"), writer, batch_id)
        finally:
            batch.unpersist()
    return run


def delivery_totals(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """Alerts received and delivered so far, by channel."""
    counts = spark.read.parquet(cfg.out(spark, "dispatch_counts"))
    return counts.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("received", "live", "chat")])


def _trigger(writer, every: str | None, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every) if every else writer


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State outside the heap, in a bounded part of each executor's memory; changes are logged, not whole files of the store copied.
STATE_CONF = {
    _PROVIDER: DEFAULT_CONF[_PROVIDER],
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: State in the heap, of one batch only; what is known of the batches before is in the checkpoint.
HEAP_CONF = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
             "spark.sql.streaming.maxBatchesToRetainInMemory": "1"}


@contextmanager
def _state_conf(spark: SparkSession, cfg: StreamConfig):
    """The session's settings for queries that start within: a query keeps those it was started with."""
    wanted = (HEAP_CONF if cfg.state_heap else STATE_CONF) | {k: str(v) for k, v in (("spark.sql.shuffle.partitions", cfg.state_tasks),
                                                  ("spark.sql.streaming.minBatchesToRetain", cfg.state_batches)) if v}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_query(df: DataFrame, name: str, cfg: StreamConfig, spark: SparkSession, foreach=None,
                mode: str = "append", every: str | None = None, sink: str | None = None) -> StreamingQuery:
    """Start one query with its trigger, output mode and own checkpoint."""
    writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", cfg.ckpt(spark, name))
    writer = _trigger(writer, every, cfg.available_now)
    if foreach is not None:
        writer = writer.foreachBatch(foreach)
    elif sink == "memory":
        writer = writer.format("memory")
    else:
        writer = writer.format("parquet").option("path", cfg.out(spark, name))
    with _state_conf(spark, cfg):
        return writer.start()


def start_bridge(spark: SparkSession, cfg: StreamConfig) -> StreamingQuery:
    """The device bridge: message files -> broker records, quarantine, counts."""
    return start_query(read_device_messages(spark, cfg), "bridge", cfg, spark, foreach=bridge_batch(spark, cfg), every=cfg.raw_trigger)


def start_delivery(spark: SparkSession, cfg: StreamConfig, users=None) -> StreamingQuery:
    """Alert delivery: alert records -> outbox and counters."""
    users = users or (lambda: read_table(spark, cfg.users_root, "users"))
    alerts = read_alerts(spark, cfg) if cfg.source_format in ("kafka", "topics") else read_alert_records(spark, cfg)
    return start_query(alerts, "delivery", cfg, spark, foreach=deliver_batch(spark, cfg, users), every=cfg.raw_trigger)


def start_all(spark: SparkSession, cfg: StreamConfig) -> list[StreamingQuery]:
    """The raw fan-out, the window aggregate, the HR watch (closed minutes, and early flags) over one source; the bridge
    and the delivery where configured."""
    parsed = read_readings(spark, cfg)
    raw_q = start_query(read_marked(spark, cfg), "raw", cfg, spark, foreach=process_batch(spark, cfg), every=cfg.raw_trigger)
    agg_q = start_query(windowed(parsed, cfg), "agg", cfg, spark, foreach=agg_batch(spark, cfg),
                        mode=cfg.agg_mode, every=cfg.agg_trigger)
    hr_q = start_query(hr_watch(once(parsed, cfg, "heart_rate")).where(F.col("flagged")), "hr_watch",
                       cfg, spark, mode="append", every=cfg.raw_trigger)
    few = replace(cfg, state_heap=False, state_tasks=cfg.state_tasks and -(-cfg.state_tasks // 3))  # sums of a few minutes; a task has a Python worker
    early_q = start_query(early_watch(parsed, cfg.watermark), "hr_early", few, spark, mode="append", every=cfg.raw_trigger)
    queries = [raw_q, agg_q, hr_q, early_q]
    if cfg.device_path:
        queries.append(start_bridge(spark, cfg))
    if cfg.users_root:
        queries.append(start_delivery(spark, cfg))
    return queries


def run_forever(spark: SparkSession, cfg: StreamConfig) -> None:
    """Start everything and wait on any termination."""
    start_all(spark, cfg)
    spark.streams.awaitAnyTermination()


def main(argv: list[str] | None = None) -> None:
    """Command line: ``python -m pulsegrid.streaming.jobs --source-format kafka --bootstrap host:9092``."""
    import argparse

    from ..session import build_session

    ap = argparse.ArgumentParser(description="Run the reading stream: raw fan-out, window aggregate, HR watch.")
    ap.add_argument("--source-format", default="kafka", choices=["kafka", "topics", "records", "json", "parquet"])
    ap.add_argument("--starting-offsets", default="latest")
    ap.add_argument("--source-path")
    ap.add_argument("--bootstrap")
    ap.add_argument("--out-root")
    ap.add_argument("--checkpoint")
    ap.add_argument("--device-path", help="device messages as JSON files: run the bridge too")
    ap.add_argument("--alerts-path", help="alert records as JSON files, for the delivery")
    ap.add_argument("--users-root", help="folder of the users table: run the alert delivery too")
    ap.add_argument("--max-offsets-per-trigger", type=int, default=StreamConfig.max_offsets_per_trigger)
    ap.add_argument("--agg-mode", default="update", choices=["update", "append"])
    ap.add_argument("--available-now", action="store_true", help="drain the current input and stop")
    args = ap.parse_args(argv)
    spark = build_session(app_name="pulsegrid-stream")
    cfg = StreamConfig(source_format=args.source_format, source_path=args.source_path, bootstrap=args.bootstrap,
                       out_root=args.out_root, checkpoint=args.checkpoint, agg_mode=args.agg_mode,
                       available_now=args.available_now, device_path=args.device_path, alerts_path=args.alerts_path,
                       users_root=args.users_root, starting_offsets=args.starting_offsets, max_offsets_per_trigger=args.max_offsets_per_trigger)
    if args.available_now:
        for q in start_all(spark, cfg):
            q.awaitTermination()
    else:
        run_forever(spark, cfg)


if __name__ == "__main__":
    main()
