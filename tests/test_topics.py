"""Topic logs as a source: offsets, topics by pattern, replays, lost segments, restarts."""

from __future__ import annotations

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import topics as T
from pulsegrid.streaming import jobs as J

from test_streaming import _drain


def _records(spark, topic, first, n):
    rows = [(f"k{i % 3}", json.dumps({"n": i}), topic, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(first, first + n)]
    return spark.createDataFrame(rows, "key string, value string, topic string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def _batch(spark, path, **options):
    T.register(spark)
    reader = spark.read.format(T.FORMAT).option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def _ns(rows):
    return sorted(json.loads(r.value)["n"] for r in rows)


def test_offsets_go_on_and_keys_keep_their_partition(spark, scratch):
    path = os.path.join(scratch, "logs")
    T.append_segments(_records(spark, "biometrics.hrv", 0, 20), path, partitions=2)
    T.append_segments(_records(spark, "biometrics.hrv", 20, 10), path, partitions=2)
    rows = _batch(spark, path, subscribePattern=r"biometrics\..*").collect()
    assert _ns(rows) == list(range(30))
    for p in {r.partition for r in rows}:
        own = sorted((r.offset, r.timestamp) for r in rows if r.partition == p)
        assert [o for o, _ in own] == list(range(len(own))) and [t for _, t in own] == sorted(t for _, t in own)
    assert all(len({r.partition for r in rows if r.key == k}) == 1 for k in ("k0", "k1", "k2"))
    at = {"biometrics.hrv": {str(p): 4 for p in {r.partition for r in rows}}}
    later = _batch(spark, path, subscribePattern=r"biometrics\..*", startingOffsets=json.dumps(at)).collect()
    assert {r.offset for r in rows} - {r.offset for r in later} == {0, 1, 2, 3} and all(r.offset >= 4 for r in later)


def test_stream_restart_new_topic_and_latest(spark, scratch):
    path, out = os.path.join(scratch, "logs"), os.path.join(scratch, "out")
    cfg = J.StreamConfig(available_now=True, checkpoint=os.path.join(scratch, "ckpt"), out_root=out, source_path=path)
    T.register(spark)

    def run(name="all", start="earliest"):
        stream = spark.readStream.format(T.FORMAT).option("path", path).option("subscribePattern", r"biometrics\..*").option("startingOffsets", start).load()
        _drain(J.start_query(stream, name, cfg, spark))
        return _ns(spark.read.schema(T.SCHEMA).parquet(os.path.join(out, name)).collect())

    T.append_segments(_records(spark, "biometrics.hrv", 0, 5), path)
    T.append_segments(_records(spark, "alerts.detected", 500, 5), path)
    assert run() == list(range(5)) and run("late", "latest") == []
    T.append_segments(_records(spark, "biometrics.oxygen", 100, 4), path)  # a topic that was not there
    T.append_segments(_records(spark, "biometrics.hrv", 5, 3), path)
    want = [*range(8), *range(100, 104)]
    assert run() == want and run("late", "latest") == [5, 6, 7, 100, 101, 102, 103]


def test_lost_segments_are_skipped_or_refused(spark, scratch):
    path = os.path.join(scratch, "logs")
    T.append_segments(_records(spark, "t", 0, 6), path, partitions=1)
    T.append_segments(_records(spark, "t", 6, 6), path, partitions=1)
    first, second = T.segments(path)[("t", 0)]
    assert (first[:2], second[:2]) == ((0, 5), (6, 11))
    shutil.move(first[2], os.path.join(scratch, "gone"))  # retention
    assert _ns(_batch(spark, path, subscribe="t").collect()) == list(range(6, 12))
    with pytest.raises(Exception, match="are gone"):
        _batch(spark, path, subscribe="t", failOnDataLoss="true").collect()
    assert _batch(spark, path, subscribe="other,t2").collect() == []
