"""Registered stream queries (S1, S4, K5, K6, K10, W1-W6, P9, A16): each runs its streams over files and reads what they wrote.

The input files are the device messages of the ``wire`` view and the broker
records that the library's own bridge makes of them (unreadable payloads
included, as values).  Streams run with ``availableNow``: they drain the files
and stop.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import aggregates as A
from ..operators import ingest as I
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import keyed as KD
from ..sources import stored as ST
from ..sources import topics as T
from ..sources import versions as V
from ..sources.tables import read_table
from ..streaming import buffer as B
from ..streaming import compaction as CP
from ..streaming import jobs as J
from ..streaming import rollups as R
from ..streaming import sinks as K
from . import q_aggregates
from .catalog import ORACLES, query
from .common import AS_OF, CONTEXT_HOURS, _memo, alerts_of, dates_as_timestamps, readings_of, users_of
from .oracle_views import with_views
from .q_ingest import DEVICE_PREFIX, GOOD, METRIC_SQL, TYPE_SQL

COUNTED = f"""
SELECT event_id, user_id, event_time, {METRIC_SQL} AS metric, value, unit, phase, source_name FROM readings WHERE {GOOD}"""
DELAY = "INTERVAL {} {}".format(*C.WATERMARK_DELAY.split())
ALERT_OK = "event_id % 97 <> 0 AND event_id % 25 <> 7"


FILE_ROWS = 50_000   # records in a file, about: a compressed file is one task's to read
TASK_ROWS = 50_000   # records of a micro-batch for each core that the cluster has


def _files(spark) -> int:
    """How many files the generated input has: one a shuffle task, so that reading it is spread however large it is."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _records(spark, root) -> str:
    """A folder of broker record files: the bridge's records, and the unreadable payloads as they are."""
    return _landed(spark, root)[0]


def _landed(spark, root) -> tuple[str, int | None]:
    """The folder of ``_records``, and how many of its files a micro-batch may take (None: all).

    As from a broker, the records come in order of time, a minute in one file:
    however many there are, a stream takes them in batches of bounded size and
    its watermark lets go of the state of those before.  A file is one task's
    to read, so its rows are bounded too.
    """
    def write() -> tuple[str, int | None]:
        path, n = scratch_path(spark, "records"), read_table(spark, root, "events").count()
        files = max(_files(spark), -(-n // FILE_ROWS))
        rows = I.bridge_all(X.wire(spark, root, files, by_time=True), now=AS_OF)
        rows.select("key", "value", "topic", "timestamp").write.option("compression", "gzip").json(path)
        batches = -(-n // (TASK_ROWS * spark.sparkContext.defaultParallelism))
        found = V.order_by_name(spark, f"{path}/part-*")
        return path, -(-found // batches) if found and batches > 1 else None

    return _memo(spark, root, "records", write)


def _source(spark, root, **options) -> dict:
    """Stream options: the record files in batches of bounded size, state as wide as the cluster, and of it what a restart needs."""
    path, take = _landed(spark, root)
    width = min(_files(spark), max(4, 2 * spark.sparkContext.defaultParallelism))
    return {"source_format": "records", "source_path": path, "max_files_per_trigger": take, "state_tasks": width, "state_batches": 2,
            "state_heap": take is not None} | options


def _config(spark, name: str, **options) -> J.StreamConfig:
    base = scratch_path(spark, f"stream-{name}")
    return J.StreamConfig(available_now=True, checkpoint=os.path.join(base, "checkpoint"), out_root=os.path.join(base, "out"), **options)


def _drain(*queries) -> None:
    for q in queries:
        q.awaitTermination()


def _all(spark, root) -> J.StreamConfig:
    """Every job over the record files; windows in update mode."""
    def start() -> J.StreamConfig:
        cfg = _config(spark, "all", **_source(spark, root))
        _drain(*J.start_all(spark, cfg))
        return cfg

    return _memo(spark, root, "stream-all", start)


@query("s1_stream_readings", with_views(f"""
SELECT user_id, {TYPE_SQL} AS type, unit, value, {METRIC_SQL} AS metric, phase, event_time,
       'biometrics.' || {METRIC_SQL} AS kafka_topic FROM readings WHERE {GOOD}
""", "readings"))
def s1_stream_readings(spark, root):
    """S1 + W3 + W5: the reading stream in two runs of one checkpoint; the restart goes on with the files that came meanwhile."""
    cfg = _config(spark, "s1", source_format="records", source_path=scratch_path(spark, "s1-files"), max_files_per_trigger=_files(spark))
    for half in range(2):
        rows = spark.read.schema("key string, value string, topic string, timestamp timestamp").json(_records(spark, root))
        rows.where(F.pmod(F.xxhash64("value", "timestamp"), F.lit(2)) == half).write.mode("append").option("compression", "gzip").json(cfg.source_path)
        readings = J.read_readings(spark, cfg).withColumn("phase", F.try_element_at("metadata", F.lit("phase")))
        _drain(J.start_query(readings.select("user_id", "type", "unit", "value", "metric", "phase", "event_time", "kafka_topic"), "s1", cfg, spark))
    return spark.read.parquet(cfg.out(spark, "s1"))


@query("s1_stream_topics", ORACLES["s1_stream_readings"])
def s1_stream_topics(spark, root):
    """S1 + W5 over topic logs: topics by pattern, offsets kept by the checkpoint; half of the records and all topics but two come before a restart."""
    logs = scratch_path(spark, "topic-logs")
    cfg = _config(spark, "s1-topics", source_format="topics", source_path=logs, starting_offsets="earliest")
    rows = spark.read.schema("key string, value string, topic string, timestamp timestamp").json(_records(spark, root))
    early = (F.pmod(F.xxhash64("value", "timestamp"), F.lit(2)) == 0) & ~F.col("topic").isin("biometrics.hrv", "biometrics.oxygen")
    for part in (early, ~early):
        T.append_segments(rows.where(part), logs, partitions=2)
        readings = J.read_readings(spark, cfg).withColumn("phase", F.try_element_at("metadata", F.lit("phase")))
        _drain(J.start_query(readings.select("user_id", "type", "unit", "value", "metric", "phase", "event_time", "kafka_topic"), "s1", cfg, spark))
    return spark.read.parquet(cfg.out(spark, "s1"))


@query("k6_stream_history", with_views(f"""
SELECT event_time AS time, user_id, metric, value, coalesce(source_name, 'simulator') AS source,
       CASE WHEN phase IS NULL THEN '{{}}' ELSE '{{"phase":"' || phase || '"}}' END AS metadata,
       CAST(CAST(event_time AS DATE) AS TIMESTAMP) AS event_date FROM ({COUNTED}) r
""", "readings"))
def k6_stream_history(spark, root):
    """K6 + K3 + K10: history rows of the fan-out, compacted into the versioned history and read back."""
    table = scratch_path(spark, "compacted")
    CP.compact(spark, _all(spark, root).out(spark, "readings"), table)
    return dates_as_timestamps(CP.read_history(spark, table).drop("row_id"))


def _spread(spark, root) -> str:
    """A folder with the events alone, in as many files as a shuffle has tasks: a small compressed table is one task's to read, its landings are not."""
    def write() -> str:
        path = scratch_path(spark, "spread")
        read_table(spark, root, "events").repartitionByRange(_files(spark), "ts", "event_id").write.parquet(f"{path}/events.parquet")
        return path

    return _memo(spark, root, "spread", write)


def _twice_compacted(spark, root) -> str:
    """Folder of the histories of readings and alerts: two landings a table, with the landing folder cleared between them.

    The second landing brings late rows of every day, and rows of the first
    once more by another writer; the last compactions rewrite days that have
    two runs.
    """
    def write() -> str:
        base, spread = scratch_path(spark, "histories"), _spread(spark, root)
        for name, rows in (("readings", K.reading_rows(readings_of(spark, spread))), ("alerts", K.alert_rows(alerts_of(spark, spread)))):
            landing, table = f"{base}/landing-{name}", f"{base}/{name}"
            late = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
            for batch, part in enumerate((rows.where(~late), rows.where(late))):
                K.write_batch(part, landing, "writer", batch, by=("event_date",))
                CP.compact(spark, landing, table, max_runs=2)
                CP.retire(spark, landing, table, min_age_seconds=0)
                for rollup, made in _ROLLUPS.get(name, {}).items():
                    R.refresh(spark, table, f"{base}/{rollup}", made)
            K.write_batch(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(7)) == 0), landing, "replay", 0, by=("event_date",))
            CP.compact(spark, landing, table, max_runs=2)
            for rollup, made in _ROLLUPS.get(name, {}).items():
                R.refresh(spark, table, f"{base}/{rollup}", made)
        R.refresh(spark, f"{base}/minutes", f"{base}/hours", R.READING_HOURS)
        return base

    return _memo(spark, root, "histories", write)


_ROLLUPS = {"readings": {"minutes": R.READING_MINUTES, "slices": R.READING_SLICES}, "alerts": {"alert-minutes": R.ALERT_MINUTES}}


def _rolled(spark, root, name: str, **scope):
    return R.read_rollup(spark, f"{_twice_compacted(spark, root)}/{name}", **scope)


@query("a6_hr_trend_rolled", ORACLES["a6_hr_trend"])
def a6_hr_trend_rolled(spark, root):
    """A6 from the hour rollup, which was kept up through late rows and rewrites."""
    return q_aggregates._rounded(R.bucket_avg(_rolled(spark, root, "hours"), "heart_rate", "1 hour"))


@query("a7_hrv_trend_rolled", ORACLES["a7_hrv_trend"])
def a7_hrv_trend_rolled(spark, root):
    """A7 from the minute rollup, at an hour's width."""
    return q_aggregates._rounded(R.bucket_avg(_rolled(spark, root, "minutes"), "hrv", "1 hour"))


@query("a8_trend_summary_rolled", ORACLES["a8_trend_summary"])
def a8_trend_summary_rolled(spark, root):
    """A8 over the hour rollup's buckets."""
    return q_aggregates._rounded(A.bucket_summary(R.bucket_avg(_rolled(spark, root, "hours"), "heart_rate", "1 hour")),
                                 "mean_of_buckets", "min_of_buckets", "max_of_buckets")


@query("a3_metric_stats_rolled", ORACLES["a3_metric_stats"])
def a3_metric_stats_rolled(spark, root):
    """A3 with its exact median from stored hourly slice counts; raw rows are read for the window's edges and the medians' slices."""
    base = _twice_compacted(spark, root)
    return q_aggregates._rounded(R.metric_stats(spark, f"{base}/readings", f"{base}/slices", AS_OF, CONTEXT_HOURS))


@query("a3_user_stats_rolled", with_views(f"""
SELECT user_id, metric, count(*) AS n_samples, {q_aggregates.AVG} AS avg_value, min(value) AS min_value, max(value) AS max_value,
       quantile_cont(value, 0.5) AS median_value
FROM readings WHERE user_id = 7 AND event_time >= TIMESTAMP '2024-01-18 19:20:00' AND event_time <= TIMESTAMP '2024-01-24 15:20:00'
     AND metric IN ({q_aggregates.METRICS_IN}) GROUP BY ALL
""", "readings"))
def a3_user_stats_rolled(spark, root):
    """A3 for one user over a window that begins and ends within an hour; other users' files are not opened."""
    base = _twice_compacted(spark, root)
    return q_aggregates._rounded(R.metric_stats(spark, f"{base}/readings", f"{base}/slices", "2024-01-24 15:20:00", 140, user_id=7))


@query("a9_alerts_per_minute_rolled", ORACLES["a9_alerts_per_minute"])
def a9_alerts_per_minute_rolled(spark, root):
    """A9 from the alert rollup."""
    return R.alerts_per_minute(_rolled(spark, root, "alert-minutes"))


@query("a10_critical_per_minute_rolled", ORACLES["a10_critical_per_minute"])
def a10_critical_per_minute_rolled(spark, root):
    """A10 (critical) from the alert rollup."""
    return R.alerts_per_minute(_rolled(spark, root, "alert-minutes"), "critical")


@query("a11_alert_timeline_rolled", ORACLES["a11_alert_timeline"])
def a11_alert_timeline_rolled(spark, root):
    """A11 from the alert rollup."""
    return R.alert_timeline(_rolled(spark, root, "alert-minutes"))


@query("a12_alert_totals_rolled", ORACLES["a12_alert_totals"])
def a12_alert_totals_rolled(spark, root):
    """A12 from the alert rollup."""
    return R.alert_totals(_rolled(spark, root, "alert-minutes"))


@query("a13_alerts_by_category_rolled", ORACLES["a13_alerts_by_category"])
def a13_alerts_by_category_rolled(spark, root):
    """A13 from the alert rollup."""
    return R.alerts_by_category(_rolled(spark, root, "alert-minutes"))


@query("k10_compacted_history", with_views("""
SELECT event_time AS time, user_id, metric, value, coalesce(source_name, 'simulator') AS source, event_id
FROM readings
""", "readings"))
def k10_compacted_history(spark, root):
    """The reading history after three compactions: late rows, a cleared landing folder, rows landed twice."""
    rows = CP.read_history(spark, _twice_compacted(spark, root) + "/readings")
    return rows.select("time", "user_id", "metric", "value", "source", F.col("row_id").cast("bigint").alias("event_id"))


@query("k10_compacted_alerts", with_views("""
SELECT user_id, created_at, severity, category, title, text, metric, value, phase, rule_pos FROM alerts
""", "alerts"))
def k10_compacted_alerts(spark, root):
    """K10 + K4: the alert history after three compactions, read as alerts."""
    return ST.stored_alerts(spark, _twice_compacted(spark, root)).drop("event_id", "event_date")


@query("c1_user_history", with_views("""
SELECT event_time AS time, user_id, metric, value, event_id FROM readings
WHERE user_id = 7 AND event_time >= TIMESTAMP '2024-01-05 12:00:00' AND event_time <= TIMESTAMP '2024-01-20 06:00:00'
""", "readings"))
def c1_user_history(spark, root):
    """One user's readings in a time range from the history; days and files outside are not opened."""
    rows = CP.read_history(spark, _twice_compacted(spark, root) + "/readings", start="2024-01-05 12:00:00", end="2024-01-20 06:00:00", user_id=7)
    return rows.select("time", "user_id", "metric", "value", F.col("row_id").cast("bigint").alias("event_id"))


@query("k6_stream_alerts", with_views(f"""
SELECT user_id, created_at, severity, category, title, text, metric, value, phase, rule_pos FROM alerts WHERE {ALERT_OK}
""", "alerts"))
def k6_stream_alerts(spark, root):
    """K6 + K4: alert rows of the fan-out, read as alerts."""
    cfg = _all(spark, root)
    return ST.stored_alerts(spark, os.path.dirname(cfg.out(spark, "alerts"))).drop("event_id", "event_date")


@query("k6_stream_quarantine", with_views(f"""
SELECT 'unreadable' AS reason, CASE event_id // 97 % 4 WHEN 0 THEN 'not json' WHEN 1 THEN '' WHEN 2 THEN '  ' END AS raw,
       'biometrics.unknown' AS kafka_topic
FROM readings WHERE NOT ({GOOD})
""", "readings"))
def k6_stream_quarantine(spark, root):
    """K6 + P5: records that the fan-out could not put into the history, as they came."""
    rows = spark.read.schema("reason string, raw string, kafka_topic string").json(_all(spark, root).out(spark, "quarantine"))
    return rows.select("reason", "raw", "kafka_topic")


@query("k1_stream_raw_docs", with_views(f"""
SELECT 'biometrics-2024-01-31' AS "index", user_id, metric, value, unit, phase, coalesce(source_name, 'simulator') AS source FROM ({COUNTED}) r
""", "readings"))
def k1_stream_raw_docs(spark, root):
    """K1 by the fan-out: raw documents in the index of their ingest day."""
    rows = spark.read.schema("index string, user_id bigint, metric string, value double, unit string, phase string, source string").json(
        _all(spark, root).out(spark, "raw_docs"))
    return rows.select("index", "user_id", "metric", "value", "unit", "phase", "source")


WINDOWS = f"""
x AS (SELECT date_trunc('minute', event_time) - k * INTERVAL 1 MINUTE AS ws, r.* FROM ({COUNTED}) r, range(5) g(k))"""


AGG_DOCS = ("doc_id string, `@timestamp` string, user_id bigint, metric string, avg_value double, min_value double, max_value double, "
            "n_samples bigint, batch_id bigint")


def _windows_of(docs):
    return docs.select(F.to_timestamp("@timestamp").alias("window_start"), "user_id", "metric",
                       F.round(F.col("avg_value") + 1e-9, 6).alias("avg_value"), "min_value", "max_value", "n_samples")


@query("w2_stream_updates", with_views("""
SELECT ws AS window_start, user_id, metric, round(avg(value) + 1e-9, 6) AS avg_value, min(value) AS min_value,
       max(value) AS max_value, count(value) AS n_samples FROM x GROUP BY ALL
""", "readings", ctes=WINDOWS))
def w2_stream_updates(spark, root):
    """W2 + W4 + K2: window documents of the update-mode stream, the newest of each."""
    return _windows_of(K.latest_docs(spark.read.schema(AGG_DOCS).json(_all(spark, root).out(spark, "agg_docs"))))


@query("k2_compacted_docs", ORACLES["w2_stream_updates"])
def k2_compacted_docs(spark, root):
    """K2: the update-mode stream's documents absorbed into a keyed table, the newest of each."""
    table = scratch_path(spark, "agg-docs")
    KD.absorb(spark, _all(spark, root).out(spark, "agg_docs"), table, KD.AGG_DOCS, AGG_DOCS)
    return _windows_of(KD.read(spark, table, KD.AGG_DOCS))


@query("w1_stream_closed_windows", with_views("""
SELECT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, user_id, metric, round(avg(value) + 1e-9, 6) AS avg_value,
       min(value) AS min_value, max(value) AS max_value, count(value) AS n_samples FROM x
WHERE ws + INTERVAL 5 MINUTE <= (SELECT max(event_time) FROM x) - {} GROUP BY ALL
""".format(DELAY), "readings", ctes=WINDOWS))
def w1_stream_closed_windows(spark, root):
    """W1 + W4: windows that the watermark has closed, each appended once."""
    cfg = _config(spark, "w1", **_source(spark, root, agg_mode="append"))
    _drain(J.start_query(J.windowed(J.read_readings(spark, cfg), cfg), "windows", cfg, spark, mode="append"))
    return spark.read.parquet(cfg.out(spark, "windows")).withColumn("avg_value", F.round(F.col("avg_value") + 1e-9, 6))


@query("w6_stream_hr_watch", with_views("""
SELECT date_trunc('minute', event_time) AS window_start, user_id, round(avg(value) + 1e-9, 6) AS avg_hr, max(value) AS max_hr,
       count(value) AS n_samples
FROM ({}) r WHERE metric = 'heart_rate' GROUP BY ALL
HAVING avg(value) > 120 AND date_trunc('minute', event_time) + INTERVAL 1 MINUTE
       <= (SELECT max(event_time) FROM readings WHERE {}) - {}
""".format(COUNTED, GOOD, DELAY), "readings"))
def w6_stream_hr_watch(spark, root):
    """W6 + R9: the heart-rate watch that runs beside the fan-out, flagged closed minutes."""
    rows = spark.read.parquet(_all(spark, root).out(spark, "hr_watch"))
    return rows.select("window_start", "user_id", F.round(F.col("avg_hr") + 1e-9, 6).alias("avg_hr"), "max_hr", "n_samples")


@query("a1_stream_twice_sent", ORACLES["w1_stream_closed_windows"])
def a1_stream_twice_sent(spark, root):
    """A1 in the stream over records that were all sent twice: windows count each once."""
    path, take = scratch_path(spark, "records-twice"), _landed(spark, root)[1]
    rows = spark.read.schema("key string, value string, topic string, timestamp timestamp").json(_records(spark, root))
    rows = rows.withColumn("seq", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1))  # a file's copies follow it in a file
    rows = rows.withColumn("timestamp", F.explode(F.array("timestamp", F.col("timestamp") + F.expr("INTERVAL 5 SECONDS"))))
    rows.write.option("compression", "gzip").partitionBy("seq").json(path)
    take = take and (-(-take // 2) if V.order_by_name(spark, f"{path}/seq=*/part-*") else None)  # twice the rows
    cfg = _config(spark, "twice", **_source(spark, root, source_path=f"{path}/*", max_files_per_trigger=take, agg_mode="append"))
    _drain(J.start_query(J.windowed(J.read_readings(spark, cfg), cfg), "windows", cfg, spark, mode="append"))
    return spark.read.parquet(cfg.out(spark, "windows")).withColumn("avg_value", F.round(F.col("avg_value") + 1e-9, 6))


@query("t6_stream_buffer", with_views("""
SELECT user_id, rn, created_at, severity, title, event_id, rule_pos FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC, rule_pos ASC) AS INTEGER) AS rn
  FROM alerts WHERE user_id IS NOT NULL) t
WHERE rn <= 100
""", "alerts"))
def t6_stream_buffer(spark, root):
    """T6 in the stream: every user's newest 100 alerts after three batches in no order of time, some alerts twice."""
    path, cfg = scratch_path(spark, "alert-files"), _config(spark, "buffers")
    rows = K.alert_rows(alerts_of(spark, root))

    def put(batch, batch_id):
        K.write_batch(batch, cfg.out(spark, "buffers"), cfg.writer_id(spark, "buffers"), batch_id)

    for n in range(3):  # a batch a run: what landed since the run before, in however many files
        rows.where(F.pmod(F.xxhash64("row_id"), F.lit(4)).isin(n, 3)).write.mode("append").parquet(path)
        alerts = spark.readStream.schema(rows.schema).parquet(path).withColumnRenamed("row_id", "event_id")
        _drain(J.start_query(B.alert_buffers(alerts), "buffers", cfg, spark, foreach=put, mode="update"))
    kept = B.latest_buffers(spark.read.parquet(cfg.out(spark, "buffers")))
    return kept.select("user_id", "rn", "created_at", "severity", "title", F.col("event_id").cast("bigint").alias("event_id"), "rule_pos")


HR_MINUTES = f"""
m AS (SELECT date_trunc('minute', event_time) AS window_start, user_id, avg(value) AS a, max(value) AS max_hr, count(value) AS n_samples
      FROM ({COUNTED}) r WHERE metric = 'heart_rate' GROUP BY ALL),
w AS (SELECT max(event_time) - {DELAY} AS mark FROM ({COUNTED}) r WHERE metric = 'heart_rate')"""


@query("r9_stream_early", with_views("""
SELECT user_id, window_start, kind, round(a + 1e-9, 6) AS avg_hr, max_hr, n_samples, a > 120 AS flagged
FROM m, w, (SELECT 'early' AS kind UNION ALL SELECT 'closed') k
WHERE CASE kind WHEN 'early' THEN a > 120 ELSE window_start + INTERVAL 1 MINUTE <= mark END
""", "readings", ctes=HR_MINUTES))
def r9_stream_early(spark, root):
    """R9 by state and timers: early rows of the minutes above the limit, closed rows of all that the watermark has passed."""
    rows = spark.read.parquet(_all(spark, root).out(spark, "hr_early"))
    return rows.withColumn("avg_hr", F.round(F.col("avg_hr") + 1e-9, 6))


def _delivery(spark, root) -> J.StreamConfig:
    """The delivery over the alert records that the fan-out published."""
    def start() -> J.StreamConfig:
        cfg = _config(spark, "delivery", alerts_path=_all(spark, root).out(spark, "alerts_topic") + "/*/*")
        _drain(J.start_delivery(spark, cfg, lambda: users_of(spark, root)))
        return cfg

    return _memo(spark, root, "stream-delivery", start)


@query("s4_stream_outbox", with_views(f"""
SELECT a.user_id, a.created_at, a.severity, c.channel, CASE WHEN c.channel = 'chat' THEN u.contact_id END AS contact_id
FROM (SELECT * FROM alerts WHERE {ALERT_OK}) a LEFT JOIN users u ON a.user_id = u.user_id,
     (SELECT 'live' AS channel UNION ALL SELECT 'chat') c
WHERE c.channel = 'live' OR u.contact_id IS NOT NULL
""", "alerts", "users"))
def s4_stream_outbox(spark, root):
    """S4 + K5 + J1 + F1: published alert records delivered to an outbox, one row per alert and channel."""
    return spark.read.parquet(_delivery(spark, root).out(spark, "outbox")).select("user_id", "created_at", "severity", "channel", "contact_id")


@query("s4_stream_topics", ORACLES["s4_stream_outbox"])
def s4_stream_topics(spark, root):
    """S4 over topic logs: the alert topic among others, delivered to the outbox."""
    logs = scratch_path(spark, "alert-logs")
    records = spark.read.schema("key string, topic string, value string").json(_all(spark, root).out(spark, "alerts_topic") + "/*/*")
    records = records.withColumn("timestamp", F.to_timestamp(F.get_json_object("value", "$.created_at")))
    T.append_segments(records.unionByName(records.limit(5).withColumn("topic", F.lit("alerts.other"))), logs)
    cfg = _config(spark, "s4-topics", source_format="topics", alerts_path=logs, starting_offsets="earliest")
    _drain(J.start_delivery(spark, cfg, lambda: users_of(spark, root)))
    return spark.read.parquet(cfg.out(spark, "outbox")).select("user_id", "created_at", "severity", "channel", "contact_id")


@query("a16_stream_totals", with_views(f"""
SELECT count(*) AS received, count(*) AS live, count(u.contact_id) AS chat
FROM (SELECT * FROM alerts WHERE {ALERT_OK}) a LEFT JOIN users u ON a.user_id = u.user_id
""", "alerts", "users"))
def a16_stream_totals(spark, root):
    """The delivery's counters by channel."""
    return J.delivery_totals(spark, _delivery(spark, root))


def _bridged(spark, root) -> J.StreamConfig:
    """The bridge over device message files."""
    def start() -> J.StreamConfig:
        path = scratch_path(spark, "device-messages")
        X.wire(spark, root, _files(spark)).select("topic", "payload", "timestamp").write.json(path)
        cfg = _config(spark, "bridge", device_path=path, max_files_per_trigger=max(2, _files(spark) // 2))
        _drain(J.start_bridge(spark, cfg))
        return cfg

    return _memo(spark, root, "stream-bridge", start)


@query("p2_stream_bridge", with_views(f"""
SELECT coalesce(CAST(user_id AS VARCHAR), 'anonymous') AS key, 'biometrics.' || {METRIC_SQL} AS topic, {METRIC_SQL} AS metric,
       '{DEVICE_PREFIX}/' || {METRIC_SQL} AS source_topic, '{C.BRIDGE_TAG}' AS bridge, value, event_time
FROM readings WHERE {GOOD}
""", "readings"))
def p2_stream_bridge(spark, root):
    """P1-P4 as a stream job: device message files to broker records."""
    rows = spark.read.schema("key string, value string, topic string, timestamp timestamp").json(_bridged(spark, root).out(spark, "broker"))
    v = lambda name: F.get_json_object("value", f"$.{name}")
    return rows.select("key", "topic", v("metric").alias("metric"), v("source_topic").alias("source_topic"), v("bridge").alias("bridge"),
                       v("value").cast("double").alias("value"), F.to_timestamp(v("start_date")).alias("event_time"))


@query("p9_stream_totals", with_views(f"""
SELECT coalesce(metric, 'total') AS metric, count(*) AS n
FROM (SELECT {METRIC_SQL} AS metric FROM readings WHERE {GOOD}) t GROUP BY ROLLUP (metric)
""", "readings"))
def p9_stream_totals(spark, root):
    """Running totals of the bridge stream."""
    return J.bridge_totals(spark, _bridged(spark, root))
