"""Versioned tables and the history compaction: late rows, retention, crashes, writers at one time, what a read opens."""

from __future__ import annotations

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans.common import alerts_of, readings_of
from pulsegrid.sources import stored as ST
from pulsegrid.sources import versions as V
from pulsegrid.streaming import compaction as CP
from pulsegrid.streaming import sinks as K

from conftest import SF_SMALL

DAYS = ("event_date",)


def _slice(rows, n, *of):
    return rows.where(F.pmod(F.xxhash64("row_id"), F.lit(n)).isin(*of))


@pytest.fixture()
def place(spark, scratch):
    rows = K.reading_rows(readings_of(spark, SF_SMALL)).where("event_date < '2024-01-05'").persist()
    yield rows, os.path.join(scratch, "landing"), os.path.join(scratch, "history")
    rows.unpersist()


def _same(a, b):
    return a.count() == b.count() and a.select(*b.columns).exceptAll(b).count() == 0


def test_late_rows_after_retention_keep_the_day_whole(spark, place):
    rows, landing, table = place
    K.write_batch(_slice(rows, 5, 0, 1, 2, 3), landing, "w", 0, by=DAYS)
    assert CP.compact(spark, landing, table) == 1
    assert CP.retire(spark, landing, table, min_age_seconds=0) == 4 and CP.landing_batches(spark, landing) == {}
    K.write_batch(_slice(rows, 5, 4, 0), landing, "w", 1, by=DAYS)  # late rows, and some that are known
    assert CP.compact(spark, landing, table) == 2
    assert _same(CP.read_history(spark, table), rows)
    assert CP.compact(spark, landing, table) == 2  # nothing new: no version


def test_only_days_with_new_batches_are_touched(spark, place):
    rows, landing, table = place
    K.write_batch(_slice(rows, 3, 0, 1), landing, "w", 0, by=DAYS)
    CP.compact(spark, landing, table)
    before = V.state(spark, table)
    K.write_batch(_slice(rows, 3, 2).where("event_date = '2024-01-02'"), landing, "w", 1, by=DAYS)
    CP.compact(spark, landing, table)
    after = V.state(spark, table)
    assert [d for d in after["parts"] if after["parts"][d] != before["parts"][d]] == ["2024-01-02"]
    assert len(V.part_of(spark, table, after, "2024-01-02")["runs"]) == 2
    assert CP.compact(spark, landing, table, days=["2024-01-03"]) == after["number"]


def test_a_day_with_many_runs_becomes_one_sorted_run(spark, place):
    rows, landing, table = place
    for i in range(3):
        K.write_batch(_slice(rows, 3, i), landing, "w", i, by=DAYS)
        CP.compact(spark, landing, table, max_runs=3)
    at = V.state(spark, table)
    assert at["number"] == 4  # three merges and the rewrite
    assert all(len(V.part_of(spark, table, at, day)["runs"]) == 1 for day in at["parts"])
    assert _same(CP.read_history(spark, table), rows)
    part = V.part_of(spark, table, at, "2024-01-02")
    for f in V.files_of(table, "2024-01-02", part["runs"]):
        own = [(r.user_id, r.metric, -r.time.timestamp()) for r in spark.read.parquet(f).coalesce(1).collect()]
        assert own == sorted(own)


def test_what_is_new_since_a_version(spark):
    run = lambda name, *of: {"run": name, "of": list(of or (name,))}
    assert V.fresh_runs([run("a"), run("b")], [run("a")]) == [run("b")]
    assert V.fresh_runs([run("m", "a", "b"), run("c")], [run("a"), run("b")]) == [run("c")]
    assert V.fresh_runs([run("m", "a", "b")], [run("m", "a", "b")]) == [] and V.fresh_runs([run("a")], []) == [run("a")]
    assert V.fresh_runs([run("m", "a", "b")], [run("a")]) is None and V.fresh_runs([run("b")], [run("a")]) is None


def test_crash_before_the_commit_leaves_the_old_version(spark, place, monkeypatch):
    rows, landing, table = place
    K.write_batch(_slice(rows, 2, 0), landing, "w", 0, by=DAYS)
    CP.compact(spark, landing, table)
    K.write_batch(_slice(rows, 2, 1), landing, "w", 1, by=DAYS)
    old = CP.read_history(spark, table)

    def die(*a, **k):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(V, "commit", die)
        with pytest.raises(RuntimeError):
            CP.compact(spark, landing, table)
    assert V.numbers(spark, table) == [1] and _same(CP.read_history(spark, table), _slice(rows, 2, 0))
    CP.compact(spark, landing, table)
    assert _same(CP.read_history(spark, table), rows)
    assert old.count() == _slice(rows, 2, 0).count()  # a reader goes on with its version
    assert V.vacuum(spark, table, keep_versions=8, grace_seconds=3600) == 0
    assert V.vacuum(spark, table, keep_versions=8, grace_seconds=-1) == 1  # the run of the crash
    assert _same(CP.read_history(spark, table), rows) and _same(CP.read_history(spark, table, version=1), _slice(rows, 2, 0))
    assert V.vacuum(spark, table, keep_versions=1, grace_seconds=-1) == 0 and V.numbers(spark, table) == [2]


def test_of_two_writers_the_second_begins_again(spark, place, monkeypatch):
    rows, landing, table = place
    K.write_batch(_slice(rows, 3, 0), landing, "a", 0, by=DAYS)
    real, met = V.commit, []

    def commit(*args, **kw):
        if not met:  # another compaction of other rows commits first
            met.append(True)
            K.write_batch(_slice(rows, 3, 1, 2), landing, "b", 0, by=DAYS)
            CP.compact(spark, landing, table)
        return real(*args, **kw)

    monkeypatch.setattr(V, "commit", commit)
    CP.compact(spark, landing, table)
    assert _same(CP.read_history(spark, table), rows)


@pytest.mark.parametrize("creator", ["link", "rename"])
def test_one_creator_wins(spark, scratch, creator):
    path = os.path.join(scratch, "versions", "000000000001.json")
    os.makedirs(os.path.dirname(path))
    if creator == "rename":  # what HDFS and the like use, here one after the other
        _, p = V._fs(spark, path)
        assert V._rename_new(spark, p, "first")
        with pytest.raises(Exception, match="(?i)exist"):
            V._rename_new(spark, p, "second")
        assert V.read_text(spark, path) == "first" and os.listdir(os.path.dirname(path)).count("000000000001.json") == 1
        return
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if V.create_once(spark, path, json.dumps({"by": i})) else None) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and json.loads(V.read_text(spark, path)) == {"by": won[0]}


def test_point_read_opens_a_share_of_the_files(spark, scratch):
    rows = K.reading_rows(readings_of(spark, SF_SMALL))
    landing, table = os.path.join(scratch, "l"), os.path.join(scratch, "h")
    K.write_batch(rows, landing, "w", 0, by=DAYS)
    with_files = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        CP.compact(spark, landing, table)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_files)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    every = CP.read_history(spark, table).inputFiles()
    got = CP.read_history(spark, table, start="2024-01-03 00:00:00", end="2024-01-20 12:00:00", user_id=7)
    assert 0 < len(got.inputFiles()) < 0.4 * len(every)
    assert _same(got, rows.where("user_id = 7 AND time >= '2024-01-03' AND time <= '2024-01-20 12:00:00'"))
    days = CP.read_history(spark, table, start="2024-01-03 00:00:00", end="2024-01-04 00:00:00")
    assert all("part=2024-01-03" in f or "part=2024-01-04" in f for f in days.inputFiles())
    assert CP.read_history(spark, table, user_id=10 ** 9).count() == 0


def test_alert_history_and_odd_landings(spark, scratch):
    alerts = K.alert_rows(alerts_of(spark, SF_SMALL))
    landing, table = os.path.join(scratch, "l"), os.path.join(scratch, "alerts")
    assert CP.compact(spark, landing, table) == 0  # no landing folder yet
    K.write_batch(alerts, landing, "w", 0, by=DAYS)
    K.write_batch(alerts, landing, "again", 3, by=DAYS)
    CP.main(["--landing", landing, "--table", table, "--retire", "--retire-age", "0", "--vacuum", "2"])
    assert CP.landing_batches(spark, landing) == {}
    assert _same(CP.read_history(spark, table), alerts)
    back = ST.stored_alerts(spark, scratch)
    assert back.count() == alerts.count() and back.where("user_id IS NULL").count() == alerts.where("user_id IS NULL").count()


def test_a_files_user_filter_is_no_larger_than_its_users_need(spark, place):
    rows, landing, table = place
    many = rows.where("event_date = '2024-01-02'").limit(20).crossJoin(spark.range(100).withColumnRenamed("id", "i"))
    many = many.withColumns({"user_id": F.xxhash64("i", "row_id"), "row_id": F.concat("row_id", F.lit("-"), F.col("i").cast("string"))}).drop("i")
    K.write_batch(many, landing, "w", 0, by=DAYS)  # 2000 users: too many for a dictionary, so the file has a filter
    CP.compact(spark, landing, table)
    files = V.files_of(table, "2024-01-02", V.part_of(spark, table, V.state(spark, table), "2024-01-02")["runs"])
    assert sum(map(os.path.getsize, files)) < 400_000
    one = many.select("user_id").first()[0]
    assert CP.read_history(spark, table, user_id=one).count() == many.where(F.col("user_id") == one).count() > 0


def test_rows_that_came_once_are_not_shuffled_to_find_copies(spark, place):
    rows, _, _ = place
    keys = CP._keys(rows)
    assert "Aggregate" not in CP._once(rows, keys)._jdf.queryExecution().optimizedPlan().toString()
    twice = rows.unionByName(rows.where("event_date = '2024-01-03'"))
    assert sorted(r.row_id for r in CP._once(twice, keys).collect()) == sorted(r.row_id for r in rows.collect())
