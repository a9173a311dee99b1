"""Rolling alert buffers as stream state, records sent twice, and contact links as of the alert's time."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators.joins import route_alerts_as_of
from pulsegrid.streaming import buffer as B
from pulsegrid.streaming import jobs as J
from pulsegrid.streaming import sinks as K

from test_streaming import _cfg, _drain, _reading, _write_batches

BASE = dt.datetime(2024, 1, 1)
ALERT = "user_id long, created_at timestamp, severity string, category string, title string, text string, event_id string, rule_pos int"


def test_buffer_equals_the_newest_n_after_any_split(spark, scratch):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), BASE + dt.timedelta(minutes=rng.randrange(40)), "warning", "c", "t", "x", f"{i:04d}", i % 2) for i in range(60)]
    src, cfg = os.path.join(scratch, "src"), _cfg(scratch, None)
    for part in (rows[:25], rows[20:40], rows[40:], rows[:5]):  # some come again
        spark.createDataFrame(part, ALERT).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ALERT).option("maxFilesPerTrigger", 1).parquet(src)

    def put(batch, batch_id):
        K.write_batch(batch, cfg.out(spark, "buffers"), "w", batch_id)

    _drain(J.start_query(B.alert_buffers(stream, n=7), "buffers", cfg, spark, foreach=put, mode="update"))
    got = B.latest_buffers(spark.read.parquet(cfg.out(spark, "buffers")))
    for user in (1, 2):
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (-r[1].timestamp(), -int(r[6]), r[7]))[:7]
        assert [(r.rn, r.event_id) for r in got.where(F.col("user_id") == user).orderBy("rn").collect()] == [(i + 1, r[6]) for i, r in enumerate(own)]
    assert got.where("user_id IS NULL").count() == 0


def test_records_sent_twice_count_once_in_windows(spark, scratch):
    src = os.path.join(scratch, "src")
    first = [_reading(1, BASE + dt.timedelta(seconds=10), 80.0), _reading(1, BASE + dt.timedelta(seconds=20), 90.0)]
    end = [[_reading(2, BASE + dt.timedelta(hours=1))], [_reading(2, BASE + dt.timedelta(hours=1, seconds=1))]]
    _write_batches(src, [first + first[:1], first, *end])
    for dedup, n in ((True, 2), (False, 5)):
        cfg = _cfg(os.path.join(scratch, str(dedup)), src, agg_mode="append", dedup=dedup)
        _drain(J.start_query(J.windowed(J.read_readings(spark, cfg), cfg), f"twice_{dedup}", cfg, spark, mode="append", sink="memory"))
        windows = spark.table(f"twice_{dedup}").where("user_id = 1").collect()
        assert len(windows) == 5 and {r.n_samples for r in windows} == {n}


def test_link_as_of_the_alerts_time(spark):
    rng = random.Random(8)
    at = lambda: BASE + dt.timedelta(minutes=rng.randrange(6 * 1440) // 30 * 30)  # noqa: E731  many equal times
    links = [(s, rng.choice([1, 1, 1, 2, 3]), None if s % 9 == 0 else f"c{s}", at()) for s in range(80)] + [(99, None, "x", at()), (100, 1, "x", None)]
    alerts = [(i, rng.choice([1, 1, 1, 1, 2, 4, None]), at()) for i in range(150)]
    rng.shuffle(links)
    got = route_alerts_as_of(spark.createDataFrame(alerts, "event_id long, user_id long, created_at timestamp"),
                             spark.createDataFrame(links, "seq long, user_id long, contact_id string, linked_at timestamp"))
    assert got.columns == ["event_id", "user_id", "created_at", "contact_id"]
    want = {}
    for i, user, when in alerts:
        held = [(t, s, c) for s, u, c, t in links if u == user and t is not None and t <= when]
        if user is not None:
            want[i] = max(held, key=lambda x: x[:2])[2] if held else None
    assert {r.event_id: r.contact_id for r in got.collect()} == want
    empty = spark.createDataFrame([], "seq long, user_id long, contact_id string, linked_at timestamp")
    assert route_alerts_as_of(spark.createDataFrame(alerts, "event_id long, user_id long, created_at timestamp"), empty).where("contact_id IS NULL").count() == len(want)


def test_many_users_of_a_frame_are_cut_in_one_sort():
    rng, users = random.Random(6), 10_000
    rows = [(u, BASE + dt.timedelta(minutes=rng.randrange(9)), "warning", "c", "t", "x", f"{i:06d}", i % 2) for i, u in enumerate([*range(users), *([5] * 40), 7])]
    frame = pd.DataFrame(rows + rows[-3:], columns=["user_id", *B.FIELDS])
    since = time.process_time()
    got = pd.concat(B.newest_of_each(iter([frame]), 7))
    assert time.process_time() - since < 5  # a data frame a user took far longer
    own = B.newest((r[1:] for r in rows if r[0] == 5), 7)
    assert len(got) == users + 6 + 1 and list(got[got["user_id"] == 5]["event_id"]) == [a[5] for a in own]
