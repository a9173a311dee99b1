"""R9 with early rows: the crossing batch, one row a minute, closed minutes equal to the batch rule, restart."""

from __future__ import annotations

import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators.rules import hr_watch
from pulsegrid.plans.common import readings_of
from pulsegrid.streaming import jobs as J
from pulsegrid.streaming.watch import MinuteWatch, early_watch, open_minutes

from conftest import SF_SMALL
from test_streaming import _cfg, _drain, _reading, _write_batches

BASE = dt.datetime(2024, 1, 1)


def _run(spark, cfg, name, **options):
    """Rows with the batch that gave them."""
    out = cfg.out(spark, name)

    def put(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    _drain(J.start_query(early_watch(J.read_readings(spark, cfg), cfg.watermark, **options), name, cfg, spark, foreach=put))
    return [r for r in spark.read.parquet(out).orderBy("batch_id", "user_id", "window_start").collect()]


def _at(minute, second, value, user=1):
    return _reading(user, BASE + dt.timedelta(minutes=minute, seconds=second), value)


def test_early_row_comes_in_the_crossing_batch_and_once(spark, scratch):
    src = os.path.join(scratch, "src")
    _write_batches(src, [[_at(0, 1, 110.0), _at(0, 2, 110.0, user=2)], [_at(0, 10, 140.0)], [_at(0, 20, 150.0), _at(0, 30, 40.0, user=2)],
                         [_at(0, 40, 50.0), _at(1, 5, 130.0)], [_at(9, 0, 70.0)], [_at(9, 1, 70.0)]])
    rows = _run(spark, _cfg(scratch, src), "early")
    early = [(r.batch_id, r.user_id, r.window_start.minute, r.avg_hr) for r in rows if r.kind == "early"]
    assert early == [(1, 1, 0, 125.0), (3, 1, 1, 130.0)]
    closed = {(r.user_id, r.window_start.minute): (r.avg_hr, r.max_hr, r.n_samples, r.flagged) for r in rows if r.kind == "closed"}
    assert closed == {(1, 0): (112.5, 150.0, 4, False), (2, 0): (75.0, 110.0, 2, False), (1, 1): (130.0, 130.0, 1, True)}


def test_rearm(spark, scratch):
    src = os.path.join(scratch, "src")
    _write_batches(src, [[_at(0, 1, 130.0)], [_at(0, 2, 70.0)], [_at(0, 3, 250.0)], [_at(0, 4, 250.0)]])
    rows = _run(spark, _cfg(scratch, src), "rearm", rearm=100.0)
    assert [(r.batch_id, r.avg_hr) for r in rows if r.kind == "early"] == [(0, 130.0), (2, 150.0)]


def test_restart_keeps_the_state(spark, scratch):
    src = os.path.join(scratch, "src")
    _write_batches(src, [[_at(0, 1, 110.0)]])
    cfg = _cfg(scratch, src)
    assert _run(spark, cfg, "restart") == []
    _write_batches(src, [[_at(0, 1, 110.0)], [_at(0, 2, 140.0)], [_at(9, 0, 70.0)], [_at(9, 1, 70.0)]])  # the first file is known
    rows = _run(spark, cfg, "restart")
    assert [(r.kind, r.avg_hr, r.n_samples) for r in rows if r.window_start.minute == 0] == [("early", 125.0, 2), ("closed", 125.0, 2)]


def test_watch_moves_to_another_shuffle_width(spark, scratch):
    """Open minutes read from the old checkpoint go on under a new one; totals are those of one query over all."""
    first = [_at(0, 1 + u, 100.0 + u, user=u) for u in range(12)]
    second = [_at(0, 30 + u, 145.0, user=u) for u in range(12)]
    end = [[_at(9, 0, 70.0, user=99)], [_at(9, 1, 70.0, user=99)]]
    old, new = os.path.join(scratch, "old"), os.path.join(scratch, "new")
    _write_batches(old, [first])
    _write_batches(new, [second, *end])
    cfg = _cfg(os.path.join(scratch, "a"), old)
    assert _run(spark, cfg, "width") == []
    held = open_minutes(spark, cfg.ckpt(spark, "width"))
    assert sorted((r.user_id, r.minute * 60, r.n, r.total) for r in held.collect()) == [(u, int(BASE.replace(tzinfo=dt.timezone.utc).timestamp()), 1, 100.0 + u) for u in range(12)]
    held.write.parquet(os.path.join(scratch, "held"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        rows = _run(spark, _cfg(os.path.join(scratch, "b"), new), "width", initial=spark.read.parquet(os.path.join(scratch, "held")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {p for p, in open_minutes(spark, os.path.join(scratch, "b", "ckpt", "width")).select("partition_id").distinct().collect()} <= {0, 1, 2}
    assert {r.user_id: (r.n_samples, r.avg_hr, r.flagged) for r in rows if r.kind == "closed"} == {
        u: (2, (245.0 + u) / 2, (245.0 + u) / 2 > 120) for u in range(12)}
    assert sorted(r.user_id for r in rows if r.kind == "early" and r.window_start.minute == 0) == list(range(12))


def test_closed_minutes_equal_the_batch_rule(spark, scratch):
    rows = readings_of(spark, SF_SMALL).where("metric = 'heart_rate'")
    src = os.path.join(scratch, "src")
    docs = [_reading(r.user_id, r.event_time, r.value) for r in rows.orderBy("event_time").collect()]
    half = len(docs) // 2
    end = _reading(-1, dt.datetime(2024, 3, 1)), _reading(-1, dt.datetime(2024, 3, 1, 0, 0, 1))
    _write_batches(src, [docs[:half], docs[half:], [end[0]], [end[1]]])
    got = {(r.user_id, r.window_start): r for r in _run(spark, _cfg(scratch, src), "closed") if r.user_id != -1}
    got_closed = {(r.user_id, r.window_start): (round(r.avg_hr, 6), r.max_hr, r.n_samples, r.flagged) for r in got.values() if r.kind == "closed"}
    want = {(r.user_id, r.window_start): (round(r.avg_hr, 6), r.max_hr, r.n_samples, r.flagged) for r in hr_watch(rows).collect()}
    assert got_closed == want and len(want) > 100


class _Kept:
    """A state handle that counts what is asked of it."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 3 * 60_000


def test_state_is_read_and_written_once_a_batch_however_many_minutes():
    kept, watch = _Kept(), MinuteWatch(120.0, None)
    watch.init(kept)
    rows = pd.DataFrame({"user_id": [u for u in range(500) for _ in range(10)], "minute": [*range(10)] * 500, "n": 1, "total": 130.0, "high": 130.0})
    early = pd.concat(watch.handleInputRows((1,), iter([rows[:2500], rows[2500:]]), kept))
    assert len(early) == 5000 and kept.calls <= 3
    assert not len(pd.concat(watch.handleInputRows((1,), iter([rows[:1].assign(total=10.0, n=2)]), kept)))
    closed = pd.concat(watch.handleExpiredTimer((1,), kept, None))
    assert len(closed) == 1500 and kept.calls <= 10 and sorted(set(kept.value[1])) == [*range(3, 10)]
    assert list(closed[(closed["user_id"] == 0) & (closed["n_samples"] == 3)]["avg_hr"]) == [140 / 3]


def test_minutes_are_summed_as_one_by_one():
    """Random sums in several calls, with minutes without values, users beyond a float's whole numbers and users without an id."""
    import random

    rnd, big = random.Random(3), 1 << 60
    for key in (5, -1):
        kept, watch, held = _Kept(), MinuteWatch(120.0, 115.0), {}
        watch.init(kept)
        for _ in range(4):
            rows = [{"user_id": None if key < 0 else big + rnd.randrange(3), "minute": rnd.randrange(3), "n": (n := rnd.randrange(3)),
                     "total": n * 110.0 + 30 * rnd.random() * n, "high": 130.0 + rnd.random() if n else None} for _ in range(9)]
            frame = pd.DataFrame(rows) if key < 0 else pd.DataFrame(rows).astype({"user_id": "int64"})
            got = [r for f in watch.handleInputRows((key,), iter([frame[:4], frame[4:]]), kept) for r in f.itertuples()]
            want, came = set(), {(r["user_id"], r["minute"]) for r in rows}
            for r in rows:
                own = held.setdefault((r["user_id"], r["minute"]), [0, 0.0, None, True])
                own[:3] = own[0] + r["n"], own[1] + r["total"], max((v for v in (own[2], r["high"]) if v is not None), default=None)
            for at in came:
                n, total, _, armed = held[at]
                if n and armed and total / n > 120:
                    held[at][3] = False
                    want.add(at)
                elif not n or total / n <= 115:
                    held[at][3] = True
            assert {(None if r.user_id is None else int(r.user_id), int(r.window_start.timestamp()) // 60) for r in got} == want
        state = {(u, m): [n, round(t, 6), h, a] for u, m, n, t, h, a in zip(*kept.value)}
        assert state == {at: [n, round(t, 6), h, a] for at, (n, t, h, a) in held.items()}
