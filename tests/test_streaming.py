"""Structured Streaming over file sources (S1, S4, W1-W6, K1-K6, R9, J1 stream-static)."""

from __future__ import annotations

import datetime as dt
import json
import os
import time

from pyspark.sql import functions as F

from pulsegrid.operators.aggregates import flatten_window, window_agg
from pulsegrid.operators.rules import detect_alerts
from pulsegrid.plans.common import readings_of, users_of
from pulsegrid.streaming import jobs as J
from pulsegrid.streaming import sinks as K

from conftest import SF_SMALL

FIELDS = ["user_id", "type", "unit", "value", "start_date", "end_date", "source_name", "device", "metric",
          "ingested_at", "metadata", "event_time"]


def _write_batches(folder: str, batches: list[list[dict]]) -> None:
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        path = os.path.join(folder, f"part-{i:04d}.json")
        with open(path, "w") as fh:
            for r in rows:
                fh.write(json.dumps(r, default=str) + "\n")
        t = time.time() - 1000 + i
        os.utime(path, (t, t))


def _reading(user, ts, value=70.0, metric="heart_rate", phase="HKCategoryValueSleepAnalysisAwake"):
    return {"user_id": user, "type": "HKQuantityTypeIdentifierHeartRate", "unit": "count/min", "value": value,
            "start_date": ts.isoformat() + "+00:00", "end_date": ts.isoformat() + "+00:00", "metric": metric,
            "metadata": {"phase": phase}, "event_time": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}


def _cfg(scratch, src, **kw):
    return J.StreamConfig(source_format="json", source_path=src, max_files_per_trigger=1, available_now=True,
                          checkpoint=os.path.join(scratch, "ckpt"), out_root=os.path.join(scratch, "out"), **kw)


def _drain(q):
    q.awaitTermination(240)
    assert q.exception() is None, q.exception()


def test_stream_windows_equal_batch_for_closed_windows(spark, scratch):
    rows = readings_of(spark, SF_SMALL).select(*FIELDS).orderBy("event_time").collect()
    docs = [{k: (v.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if isinstance(v, dt.datetime) else v)
             for k, v in r.asDict().items()} for r in rows]
    third = len(docs) // 3
    last = rows[-1].event_time
    sentinel = [_reading(-1, last + dt.timedelta(hours=2)), _reading(-1, last + dt.timedelta(hours=2, seconds=1))]
    src = os.path.join(scratch, "src")
    _write_batches(src, [docs[:third], docs[third:2 * third], docs[2 * third:], sentinel[:1], sentinel[1:]])
    cfg = _cfg(scratch, src, agg_mode="append")
    stream = J.windowed(J.read_readings(spark, cfg), cfg)
    q = J.start_query(stream, "w_agg", cfg, spark, mode="append", sink="memory")
    _drain(q)
    got = spark.table("w_agg").where("user_id <> -1")
    batch = flatten_window(window_agg(readings_of(spark, SF_SMALL)))
    assert got.count() == batch.count()
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_late_reading_is_dropped(spark, scratch):
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    at = lambda m, s=0: base + dt.timedelta(minutes=m, seconds=s)
    src = os.path.join(scratch, "late")
    _write_batches(src, [[_reading(1, at(0, 30))], [_reading(1, at(20))], [_reading(1, at(21))],
                         [_reading(1, at(1), value=999.0), _reading(1, at(22))],
                         [_reading(1, at(120))], [_reading(1, at(120, 1))]])
    cfg = _cfg(scratch, src, agg_mode="append")
    q = J.start_query(J.windowed(J.read_readings(spark, cfg), cfg), "late_agg", cfg, spark, mode="append",
                      sink="memory")
    _drain(q)
    out = spark.table("late_agg")
    assert out.where("max_value = 999.0").count() == 0
    early = out.where(F.col("window_start") <= F.lit("2024-01-01 00:00:30").cast("timestamp")).collect()
    assert len(early) == 5 and all(r.n_samples == 1 for r in early)
    assert out.where(F.col("window_start") == F.lit("2024-01-01 00:21:00").cast("timestamp")).first().n_samples == 2


def test_restart_from_checkpoint_processes_new_files_once(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    src = os.path.join(scratch, "restart")
    _write_batches(src, [[_reading(1, base + dt.timedelta(minutes=i)) for i in range(5)],
                         [_reading(2, base + dt.timedelta(minutes=i)) for i in range(3)]])
    cfg = _cfg(scratch, src)
    _drain(J.start_query(J.read_readings(spark, cfg).select("user_id", "value", "event_time"), "raw_copy",
                         cfg, spark))
    out_path = cfg.out(spark, "raw_copy")
    assert spark.read.parquet(out_path).count() == 8
    path = os.path.join(src, "part-0002.json")
    with open(path, "w") as fh:
        fh.write(json.dumps(_reading(3, base)) + "\n")
    _drain(J.start_query(J.read_readings(spark, cfg).select("user_id", "value", "event_time"), "raw_copy",
                         cfg, spark))
    assert spark.read.parquet(out_path).count() == 9


def test_fan_out_batch_is_idempotent(spark, scratch):
    r = readings_of(spark, SF_SMALL)
    batch = r.select(*FIELDS)
    cfg = _cfg(scratch, None)
    run = J.process_batch(spark, cfg)
    run(batch, 7)
    run(batch, 7)
    alerts = spark.read.parquet(cfg.out(spark, "alerts"))
    expected = detect_alerts(r, created_at=F.col("event_time")).count()
    assert alerts.count() == expected
    assert spark.read.parquet(cfg.out(spark, "readings")).count() == r.count()
    assert spark.read.json(cfg.out(spark, "alerts_topic")).count() == expected
    assert spark.read.json(cfg.out(spark, "raw_docs")).count() == r.count()


def test_start_all_runs_three_queries(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    src = os.path.join(scratch, "all")
    _write_batches(src, [[_reading(1, base + dt.timedelta(seconds=10 * i), value=130.0) for i in range(6)],
                         [_reading(1, base + dt.timedelta(hours=1))]])
    cfg = _cfg(scratch, src, agg_mode="append")
    queries = J.start_all(spark, cfg)
    for q in queries:
        _drain(q)
    assert spark.read.parquet(cfg.out(spark, "alerts")).count() == 6
    assert spark.read.parquet(cfg.out(spark, "hr_watch")).count() >= 1


def test_alert_stream_routed_to_contacts(spark, scratch):
    users = users_of(spark, SF_SMALL)
    some = [r.user_id for r in users.select("user_id").orderBy("user_id").limit(3).collect()]
    src = os.path.join(scratch, "alerts")
    alerts = [{"user_id": u, "created_at": "2024-01-01T00:00:00Z", "severity": "warning", "category": "general",
               "title": "t", "text": "x", "metric": "temperature", "value": 35.0} for u in some + [999999]]
    _write_batches(src, [alerts])
    cfg = _cfg(scratch, src)
    from pulsegrid.operators.joins import route_alerts
    routed = route_alerts(J.read_alerts(spark, cfg), users, "left")
    _drain(J.start_query(routed, "routed", cfg, spark, sink="memory"))
    out = spark.table("routed")
    assert out.count() == 4
    assert out.where("contact_id IS NOT NULL").count() == users.where(
        F.col("user_id").isin(some) & F.col("contact_id").isNotNull()).count()


def test_update_mode_docs_keep_latest_window(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    src = os.path.join(scratch, "upd")
    _write_batches(src, [[_reading(1, base + dt.timedelta(seconds=5), value=60.0)],
                         [_reading(1, base + dt.timedelta(seconds=20), value=80.0)]])
    cfg = _cfg(scratch, src, agg_mode="update")
    q = J.start_query(J.windowed(J.read_readings(spark, cfg), cfg), "agg", cfg, spark,
                      foreach=J.agg_batch(spark, cfg), mode="update")
    _drain(q)
    from pulsegrid.streaming.sinks import latest_docs
    docs = spark.read.json(cfg.out(spark, "agg_docs"))
    assert docs.count() == 10  # five windows, each written by both batches
    latest = latest_docs(docs)
    assert latest.count() == 5
    assert {r.n_samples for r in latest.collect()} == {2}


def test_ingest_counts_on_a_stream_complete_mode(spark, scratch):
    from pulsegrid.operators.ingest import ingest_counts
    base = dt.datetime(2024, 1, 1)
    src = os.path.join(scratch, "counts")
    _write_batches(src, [[_reading(1, base), _reading(2, base, metric="hrv")], [_reading(3, base)]])
    cfg = _cfg(scratch, src)
    q = J.start_query(ingest_counts(J.read_readings(spark, cfg)), "ingest_counts", cfg, spark,
                      mode="complete", sink="memory")
    _drain(q)
    got = {r.metric: r.n for r in spark.table("ingest_counts").collect()}
    assert got == {"heart_rate": 2, "hrv": 1, "total": 3}


def test_alert_records_round_trip_through_the_alert_schema(spark):
    from pulsegrid import schemas as S
    from pulsegrid.plans.common import alerts_of
    from pulsegrid.streaming.sinks import alert_records
    a = alerts_of(spark, SF_SMALL).select(*[f.name for f in S.ALERT.fields])
    back = alert_records(a).select(F.inline(F.array(F.from_json("value", S.ALERT))))
    assert back.count() == a.count()
    assert back.exceptAll(a).count() == 0


def test_empty_micro_batch_writes_nothing(spark, scratch):
    from pulsegrid import schemas as S
    cfg = _cfg(scratch, None)
    empty = spark.createDataFrame([], S.DECODED_READING)
    J.process_batch(spark, cfg)(empty, 0)
    assert not os.path.exists(cfg.out(spark, "raw_docs"))
    assert not os.path.exists(cfg.out(spark, "alerts"))


def test_stream_decodes_broker_records_like_batch(spark, scratch):
    from pulsegrid.operators import ingest as I
    from pulsegrid.sources import fixtures as X
    records, _ = I.bridge(X.wire(spark, SF_SMALL), now="2024-01-31 00:00:00")
    src = os.path.join(scratch, "records")
    records.select("key", "value", "topic", "timestamp").write.json(src)
    cfg = J.StreamConfig(source_format="records", source_path=src, available_now=True,
                         checkpoint=os.path.join(scratch, "ckpt"), out_root=os.path.join(scratch, "out"))
    cols = ["user_id", "type", "value", "metric", "kafka_topic", "event_time"]
    _drain(J.start_query(J.read_readings(spark, cfg).select(*cols), "decoded", cfg, spark, sink="memory"))
    batch = I.decode(records.drop("metric")).select(*cols)
    got = spark.table("decoded")
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def _records_cfg(scratch, name, src, out):
    return J.StreamConfig(source_format="records", source_path=src, available_now=True,
                          checkpoint=os.path.join(scratch, name), out_root=out)


def _record(value, ts="2024-01-01T00:00:00Z", topic="biometrics.heart_rate"):
    return {"key": "1", "value": value, "topic": topic, "timestamp": ts}


def _value(user, ts="2024-01-01T00:00:00+00:00", **more):
    return json.dumps({"user_id": user, "type": "HKQuantityTypeIdentifierHeartRate", "unit": "count/min", "value": 70.0,
                       "start_date": ts, "metric": "heart_rate", "ingested_at": ts, **more})


def test_new_checkpoint_on_an_old_output_keeps_its_rows(spark, scratch):
    """A second stream with another checkpoint starts at batch 0 again and must not touch the first one's rows."""
    out = os.path.join(scratch, "out")
    for user in (1, 2):
        src = os.path.join(scratch, f"src{user}")
        _write_batches(src, [[_record(_value(user))]])
        cfg = _records_cfg(scratch, f"ckpt{user}", src, out)
        _drain(J.start_query(J.read_marked(spark, cfg), "raw", cfg, spark, foreach=J.process_batch(spark, cfg)))
    rows = spark.read.parquet(os.path.join(out, "readings"))
    assert sorted(r.user_id for r in rows.collect()) == [1, 2]
    assert rows.select("writer_id").distinct().count() == 2


def test_replay_on_another_day_writes_the_same_documents(spark, scratch):
    """Index and ids come from the record, not from the clock of the write."""
    from pulsegrid.streaming import sinks as K
    cfg = _cfg(scratch, None)
    batch = readings_of(spark, SF_SMALL).limit(50).select(*FIELDS)
    docs = K.raw_docs(batch)
    assert {r["index"] for r in docs.select("index").distinct().collect()} == {
        f"biometrics-{r.d}" for r in batch.select(F.date_format("event_time", "yyyy-MM-dd").alias("d")).distinct().collect()}
    assert docs.select("doc_id").distinct().count() == 50
    run = J.process_batch(spark, cfg)
    run(batch, 0)
    run(batch, 0)
    assert spark.read.json(cfg.out(spark, "raw_docs")).count() == 50


def test_malformed_and_incomplete_records_go_to_quarantine(spark, scratch):
    bad = ["not json", "", "   ", None, "null", _value(None), _value(1, "no time"), json.dumps({"user_id": 1, "start_date": "2024-01-01T00:00:00Z"})]
    src = os.path.join(scratch, "src")
    _write_batches(src, [[_record(v) for v in bad] + [_record(_value(7))]])
    cfg = _records_cfg(scratch, "ckpt", src, os.path.join(scratch, "out"))
    for q in J.start_all(spark, cfg):
        _drain(q)
    rows = spark.read.parquet(cfg.out(spark, "readings")).collect()
    assert [r.user_id for r in rows] == [7] and all(r.time and r.metric for r in rows)
    held = spark.read.schema("reason string, raw string").json(cfg.out(spark, "quarantine")).collect()
    assert sorted(r.reason for r in held) == ["no metric", "no time", "no user"] + ["unreadable"] * 5
    assert sorted(r.raw or "" for r in held) == sorted(v or "" for v in bad)
    assert spark.read.json(cfg.out(spark, "raw_docs")).count() == 1


def test_bridge_passes_unknown_fields(spark):
    from pulsegrid.operators.ingest import bridge
    payload = '{"user_id":5,"type":"x","value":1.5,"extra":{"a":[1,2]},"metric":"sent by the device","none":null}'
    msgs = spark.createDataFrame([("wearable/a/b", payload), ("t", ""), ("t", "[1]x")], "topic string, payload string")
    records, bad = bridge(msgs, now="2024-01-01 00:00:00")
    value = json.loads(records.first().value)
    assert value["extra"] == {"a": [1, 2]} and value["none"] is None and value["metric"] == "unknown" and value["bridge"]
    assert records.count() == 1 and bad.count() == 2


def test_delivery_replay_and_channels(spark, scratch):
    src = os.path.join(scratch, "alerts")
    rows = [{"key": str(u), "topic": "alerts.detected", "value": json.dumps({
        "user_id": u, "created_at": "2024-01-01T00:00:00.000000+00:00", "severity": "warning", "category": "general", "title": "t",
        "text": "x", "metric": "temperature", "value": 35.0})} for u in (1, 2, None)]
    _write_batches(src, [rows])
    users = spark.createDataFrame([(1, "chat-1"), (2, None)], "user_id long, contact_id string")
    cfg = J.StreamConfig(alerts_path=src, available_now=True, checkpoint=os.path.join(scratch, "c"), out_root=os.path.join(scratch, "o"))
    _drain(J.start_delivery(spark, cfg, lambda: users))
    out = spark.read.parquet(cfg.out(spark, "outbox"))
    assert sorted((r.user_id, r.channel) for r in out.collect()) == [(1, "chat"), (1, "live"), (2, "live")]
    assert out.select("outbox_id").distinct().count() == 3
    assert tuple(J.delivery_totals(spark, cfg).first()) == (3, 2, 1)


def test_json_batches_are_compressed_and_read_back(spark, scratch):
    rows = [(f"{i:064d}", "heart_rate") for i in range(2000)]
    K.write_batch(spark.createDataFrame(rows, "doc_id string, metric string"), os.path.join(scratch, "docs"), "w", 3, "json")
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(scratch) for f in files if f.startswith("part-"))
    assert size < 2000 * 20
    got = spark.read.schema("doc_id string, metric string, writer_id string, batch_id long").json(os.path.join(scratch, "docs"))
    assert sorted((r.doc_id, r.metric, r.writer_id, r.batch_id) for r in got.collect()) == [(*r, "w", 3) for r in rows]


def test_record_files_are_spread_over_the_shuffle_tasks(spark):
    from pulsegrid.plans import q_stream
    from pulsegrid.sources import fixtures as X
    plan = X.wire(spark, SF_SMALL, q_stream._files(spark))
    assert plan.rdd.getNumPartitions() == q_stream._files(spark) == 4
    sizes = plan.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(sizes) == 4
    assert plan.exceptAll(X.wire(spark, SF_SMALL)).count() == 0


def test_watch_keeps_ids_of_its_metric_under_the_watermark_of_all(spark, scratch):
    src, at = os.path.join(scratch, "src"), dt.datetime(2024, 1, 1)
    others = [[_reading(2, at + dt.timedelta(minutes=9, seconds=n), 50.0, metric="hrv")] for n in range(3)]
    _write_batches(src, [[_reading(1, at, 130.0), _reading(1, at, 130.0)], *others])
    cfg = _cfg(scratch, src)
    query = J.start_query(J.once(J.read_readings(spark, cfg), cfg, "heart_rate").groupBy(F.window("event_time", "1 minute")).count(),
                          "own_ids", cfg, spark, sink="memory")
    query.awaitTermination()
    assert [r["count"] for r in spark.table("own_ids").collect()] == [1]  # closed by the other metric's time
    known = [o for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "dedupeWithinWatermark"]
    assert sum(o["numRowsUpdated"] for o in known) == 1


def test_histories_land_from_many_files_with_the_same_events(spark, scratch):
    from pulsegrid.plans import q_stream as Q
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(500)
    events = events.unionByName(events.limit(20)).unionByName(events.limit(5).withColumns({"ts": F.lit(None).cast("timestamp"), "event_id": F.lit(None).cast("bigint")}))
    events.coalesce(1).write.parquet(f"{scratch}/events.parquet")  # one file, read by one task
    spread = spark.read.parquet(Q._spread(spark, scratch) + "/events.parquet")
    assert len(spread.inputFiles()) >= 4
    given = spark.read.parquet(f"{scratch}/events.parquet")
    assert spread.schema == given.schema and spread.count() == given.count() == 525
    assert spread.exceptAll(given).count() == 0


def test_generated_records_come_in_bounded_batches_in_order_of_time(spark, monkeypatch, tmp_path):
    """However many readings there are, a micro-batch takes so many; what the streams give is what one batch of all gives."""
    from pulsegrid.plans import q_stream as Q

    few, one = str(tmp_path / "few"), str(tmp_path / "one")  # other paths: nothing is shared
    for root in (few, one):
        os.makedirs(root)
        events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
        events = events.withColumn("ts", F.when(F.col("event_id") % 50 != 3, F.col("ts")))  # some have no time
        events.unionByName(events.where("event_id % 10 = 0")).write.parquet(f"{root}/events.parquet")  # and some come twice
    names = ("w1_stream_closed_windows", "a1_stream_twice_sent", "w2_stream_updates", "k2_compacted_docs", "w6_stream_hr_watch", "r9_stream_early",
             "k6_stream_quarantine", "k1_stream_raw_docs", "k6_stream_history", "k6_stream_alerts")
    whole = Q._landed(spark, one)
    assert whole[1] is None
    monkeypatch.setattr(Q, "TASK_ROWS", 60)  # 4 cores: about 5 batches
    monkeypatch.setattr(Q, "FILE_ROWS", 40)
    path, take = Q._landed(spark, few)
    files = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    assert len(files) > 2 * take
    assert files == sorted(files, key=lambda n: os.stat(os.path.join(path, n)).st_mtime_ns)
    records = spark.read.schema("timestamp timestamp").json(path).select(F.date_trunc("minute", "timestamp").alias("m"), F.input_file_name().alias("f"))
    span = records.groupBy("f").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo is not null").orderBy("f").collect()
    assert all(a.hi < b.lo for a, b in zip(span, span[1:]))  # a minute is in one file, in order
    cfg = Q._all(spark, few)
    for table in ("raw", "agg", "hr_watch"):
        assert len([n for n in os.listdir(os.path.join(cfg.checkpoint, table, "commits")) if n.isdigit()]) >= 2, table
    fresh = lambda df: df.where(" and ".join(f"`{f.name}` < timestamp '2025-01-01'" for f in df.schema.fields if f.dataType.typeName() == "timestamp") or "true")
    for name in names:  # a reading without a time is stamped when it is sent, which is another time for each folder
        got, want = (fresh(getattr(Q, name)(spark, root)) for root in (few, one))
        assert want.count() > 0 and got.count() == want.count(), name
        assert got.exceptAll(want).count() == 0, name


def test_state_settings_are_the_querys_alone(spark, scratch):
    src = os.path.join(scratch, "src")
    _write_batches(src, [[_reading(1, dt.datetime(2024, 1, 1))]])
    before = {k: spark.conf.get(k, None) for k in (*J.STATE_CONF, *J.HEAP_CONF, "spark.sql.shuffle.partitions", "spark.sql.streaming.minBatchesToRetain")}
    for heap in (False, True):
        cfg = _cfg(os.path.join(scratch, str(heap)), src, state_tasks=3, state_batches=2, state_heap=heap)
        _drain(J.start_query(J.windowed(J.read_readings(spark, cfg), cfg), f"own_{heap}", cfg, spark, mode="append", sink="memory"))
        with open(os.path.join(cfg.checkpoint, f"own_{heap}", "offsets", "0")) as f:
            said = f.read()
        assert '"spark.sql.shuffle.partitions":"3"' in said and ("HDFSBacked" if heap else "RocksDB") in said
        assert before == {k: spark.conf.get(k, None) for k in before}
