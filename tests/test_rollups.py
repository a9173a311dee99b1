"""Rollups: equal to the raw queries through late rows and rewrites, a row counts once, and no raw row is read."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates as A
from pulsegrid.plans.common import alerts_of, readings_of
from pulsegrid.sources import stored as ST
from pulsegrid.sources import versions as V
from pulsegrid.streaming import compaction as CP
from pulsegrid.streaming import rollups as R
from pulsegrid.streaming import sinks as K

from conftest import SF_SMALL


def _slice(rows, n, *of):
    return rows.where(F.pmod(F.xxhash64("row_id"), F.lit(n)).isin(*of))


def _land(spark, rows, base, batch, max_runs=4):
    K.write_batch(rows, f"{base}/landing", "w", batch, by=("event_date",))
    return CP.compact(spark, f"{base}/landing", f"{base}/readings", max_runs=max_runs)


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def _trend(spark, base):
    return _rows(R.bucket_avg(R.read_rollup(spark, f"{base}/minutes"), "heart_rate", "1 hour"))


def _raw_trend(rows):
    return _rows(A.bucket_avg(rows, "heart_rate", "1 hour", time_col="time"))


@pytest.fixture()
def rows(spark):
    out = K.reading_rows(readings_of(spark, SF_SMALL)).where("event_date < '2024-01-06'").persist()
    yield out
    out.unpersist()


def test_late_rows_add_to_their_minutes_only(spark, scratch, rows):
    _land(spark, _slice(rows, 4, 0, 1, 2), scratch, 0)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    before = V.state(spark, f"{scratch}/minutes")
    _land(spark, _slice(rows, 4, 3).where("event_date = '2024-01-03'"), scratch, 1)
    number = R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    after = V.state(spark, f"{scratch}/minutes")
    assert [d for d in after["parts"] if after["parts"][d] != before["parts"].get(d)] == ["2024-01-03"]
    late = V.part_of(spark, f"{scratch}/minutes", after, "2024-01-03")["runs"][-1]
    assert late["rows"] <= _slice(rows, 4, 3).where("event_date = '2024-01-03'").count()  # only the late rows' minutes
    assert R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES) == number
    assert _trend(spark, scratch) == _raw_trend(CP.read_history(spark, f"{scratch}/readings"))


def test_rewritten_days_are_not_read_again(spark, scratch, rows):
    _land(spark, _slice(rows, 3, 0), scratch, 0, max_runs=2)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    _land(spark, _slice(rows, 3, 1), scratch, 1, max_runs=9)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    before = V.state(spark, f"{scratch}/minutes")
    CP.merge_runs(spark, f"{scratch}/readings", max_runs=2)  # the same rows in other files
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    after = V.state(spark, f"{scratch}/minutes")
    runs = lambda at: {d: [r["run"] for r in V.part_of(spark, f"{scratch}/minutes", at, d)["runs"]] for d in at["parts"]}
    assert runs(after) == runs(before) and after["notes"]["source"] == V.state(spark, f"{scratch}/readings")["number"]
    assert _trend(spark, scratch) == _raw_trend(_slice(rows, 3, 0, 1))


@pytest.mark.parametrize("lost", ["merged unseen", "version gone"])
def test_days_are_built_anew_where_what_is_new_cant_be_told(spark, scratch, rows, lost):
    _land(spark, _slice(rows, 3, 0), scratch, 0)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    _land(spark, _slice(rows, 3, 1), scratch, 1, max_runs=2 if lost == "merged unseen" else 9)
    if lost == "version gone":
        V.vacuum(spark, f"{scratch}/readings", keep_versions=1, grace_seconds=-1)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    assert _trend(spark, scratch) == _raw_trend(_slice(rows, 3, 0, 1))


def test_crash_between_write_and_commit_counts_nothing_twice(spark, scratch, rows, monkeypatch):
    _land(spark, rows, scratch, 0)

    def die(*a, **k):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(V, "commit", die)
        with pytest.raises(RuntimeError):
            R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    assert _trend(spark, scratch) == _raw_trend(rows)


def test_many_refreshes_stay_few_runs_and_hours_follow(spark, scratch, rows):
    for i in range(5):
        _land(spark, _slice(rows, 5, i), scratch, i)
        R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES, max_runs=3)
        R.refresh(spark, f"{scratch}/minutes", f"{scratch}/hours", R.READING_HOURS, max_runs=3)
    at = V.state(spark, f"{scratch}/minutes")
    assert all(len(V.part_of(spark, f"{scratch}/minutes", at, d)["runs"]) < 3 for d in at["parts"])
    hours = R.read_rollup(spark, f"{scratch}/hours")
    assert _rows(R.bucket_avg(hours, "heart_rate", "2 hours")) == _rows(A.bucket_avg(rows, "heart_rate", "2 hours", time_col="time"))
    assert all("/hours/" in f for f in R.bucket_avg(hours, "hrv").inputFiles())  # no raw row
    one = R.read_rollup(spark, f"{scratch}/hours", start="2024-01-02", end="2024-01-03", user_id=3)
    assert {r.event_date.day for r in one.select("event_date").distinct().collect()} <= {2, 3}
    assert {r.user_id for r in one.select("user_id").distinct().collect()} == {3}


def test_alert_rollup_counts_like_the_alerts(spark, scratch):
    alerts = K.alert_rows(alerts_of(spark, SF_SMALL))
    K.write_batch(alerts, f"{scratch}/landing", "w", 0, by=("event_date",))
    CP.compact(spark, f"{scratch}/landing", f"{scratch}/alerts")
    R.refresh(spark, f"{scratch}/alerts", f"{scratch}/alert-minutes", R.ALERT_MINUTES)
    part, raw = R.read_rollup(spark, f"{scratch}/alert-minutes"), ST.stored_alerts(spark, scratch)
    assert _rows(R.alerts_per_minute(part)) == _rows(A.alerts_per_minute(raw))
    assert _rows(R.alerts_per_minute(part, "warning")) == _rows(A.alerts_per_minute(raw, "warning"))
    assert _rows(R.alert_timeline(part)) == _rows(A.alert_timeline(raw))
    assert _rows(R.alert_totals(part)) == _rows(A.alert_totals(raw))
    assert _rows(R.alerts_by_category(part)) == _rows(A.alerts_by_category(raw))


@pytest.mark.parametrize("as_of, hours, user", [("2024-01-05 00:00:00", 72, None), ("2024-01-04 10:20:30", 6, None), ("2024-01-04 10:20:30", 0.5, None),
                                                ("2024-01-04 10:05:00", 1.5, 3), ("2024-01-05 11:59:59.5", 60, 3)])
def test_window_statistics_with_the_exact_median(spark, scratch, rows, as_of, hours, user):
    _land(spark, _slice(rows, 2, 0), scratch, 0)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/slices", R.READING_SLICES)
    _land(spark, _slice(rows, 2, 1), scratch, 1)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/slices", R.READING_SLICES)
    got = R.metric_stats(spark, f"{scratch}/readings", f"{scratch}/slices", as_of, hours, user_id=user)
    own = rows if user is None else rows.where(F.col("user_id") == user)
    assert _rows(got) == _rows(A.metric_stats(own, as_of, hours, time_col="time"))
    assert os.path.isdir(f"{scratch}/slices/versions")


def test_rows_merged_before_the_rollup_looked_are_found_between_versions(spark, scratch, rows):
    _land(spark, _slice(rows, 4, 0, 1, 2), scratch, 0)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    _land(spark, _slice(rows, 4, 3), scratch, 1, max_runs=2)  # merged at once
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/minutes", R.READING_MINUTES)
    at = V.state(spark, f"{scratch}/minutes")
    runs = [V.part_of(spark, f"{scratch}/minutes", at, d)["runs"] for d in at["parts"]]
    assert {len(r) for r in runs} == {2}
    assert sum(r[-1]["rows"] for r in runs) <= _slice(rows, 4, 3).count()  # the late rows only
    assert _trend(spark, scratch) == _raw_trend(rows)


@pytest.mark.parametrize("rollup", [R.READING_MINUTES, R.READING_SLICES])
def test_partial_rows_need_one_shuffle(spark, rows, rollup):
    made = rollup.partial(R._ranged(rollup.keyed(rows), rollup))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    assert made.count() == made.select("event_date", *rollup.keys).distinct().count()


def test_window_statistics_count_the_slices_once(spark, scratch, rows):
    _land(spark, rows, scratch, 0)
    R.refresh(spark, f"{scratch}/readings", f"{scratch}/slices", R.READING_SLICES)
    got = R.metric_stats(spark, f"{scratch}/readings", f"{scratch}/slices", "2024-01-05 00:00:00", 72)
    assert not any("/slices/" in f for f in got.inputFiles())  # their counts are kept a row a group
    assert _rows(got) == _rows(A.metric_stats(rows, "2024-01-05 00:00:00", 72, time_col="time"))
