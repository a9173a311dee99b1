"""Rollups behind the dashboards (A3, A6-A13): partial figures per minute or hour, kept up with the history.

A rollup is a versioned table of partial rows by day.  ``refresh`` looks at what the source has gained since
the version the rollup was made from, reads only those runs, adds their partial rows as a run of the day and
commits both numbers together, so a source row counts once whatever crashes or is repeated.  Late readings
add to their own minutes; a day that the source merely rewrote is not read.  What was merged before the
rollup looked is found in the source's versions in between; if they are gone, the day is built anew.

Partial rows combine by sum, min and max; readers group them once more, at any width.  A rollup may be the
source of a wider one (hours from minutes).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.quantiles import pick_percentile, slice_parts, stats_of_parts, value_slice
from ..session import ensure_utc, scratch_path
from ..sources import versions as V
from .compaction import read_history

DAY = "event_date"
MAX_RUNS = 8
COMBINE: dict[str, Callable[[str], Column]] = {"n": F.sum, "total": F.sum, "rows": F.sum, "low": F.min, "high": F.max}


class Rollup(NamedTuple):
    """``keys`` of a partial row within a day, how source rows get them (``keyed``), and how keyed rows become partial rows (columns of ``COMBINE``)."""
    keys: tuple[str, ...]
    keyed: Callable[[DataFrame], DataFrame]
    partial: Callable[[DataFrame], DataFrame]


def _reading_minutes(rows: DataFrame) -> DataFrame:
    keyed = rows.groupBy(DAY, "user_id", "metric", "minute")
    return keyed.agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def _reading_hours(rows: DataFrame) -> DataFrame:
    keyed = rows.groupBy(DAY, "user_id", "metric", "hour")
    return keyed.agg(*[COMBINE[c](c).alias(c) for c in ("n", "total", "low", "high")])


def _alert_minutes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(DAY, "user_id", "minute", "severity", "category").agg(F.count(F.lit(1)).alias("n"))


def _reading_slices(rows: DataFrame) -> DataFrame:
    return slice_parts(rows, [DAY, "user_id", "metric", "hour"], "value", "slice").withColumnsRenamed(
        {"_all": "rows", "_c": "n", "_s": "total", "_lo": "low", "_hi": "high"})


READING_MINUTES = Rollup(("user_id", "metric", "minute"), lambda rows: rows.select(
    DAY, "user_id", "metric", F.date_trunc("minute", "time").alias("minute"), "value"), _reading_minutes)
READING_HOURS = Rollup(("user_id", "metric", "hour"), lambda minutes: minutes.select(
    DAY, "user_id", "metric", F.date_trunc("hour", "minute").alias("hour"), "n", "total", "low", "high"), _reading_hours)
ALERT_MINUTES = Rollup(("user_id", "minute", "severity", "category"), lambda rows: rows.select(
    DAY, "user_id", F.date_trunc("minute", "created_at").alias("minute"), "severity", "category"), _alert_minutes)
READING_SLICES = Rollup(("user_id", "metric", "hour", "slice"), lambda rows: rows.select(
    DAY, "user_id", "metric", F.date_trunc("hour", "time").alias("hour"), value_slice(F.col("value")).alias("slice"), "value"), _reading_slices)


def combined(rows: DataFrame, rollup: Rollup) -> DataFrame:
    """Partial rows with one row a key and day."""
    figures = [c for c in COMBINE if c in rows.columns]
    return rows.groupBy(DAY, *rollup.keys).agg(*[COMBINE[c](c).alias(c) for c in figures]).select(*rows.columns)


def _ranged(rows: DataFrame, rollup: Rollup) -> DataFrame:
    """Contiguous slices of the keys, one a task: rows of a key meet there, so grouping by the keys needs no shuffle of its own."""
    return rows.repartitionByRange(DAY, *rollup.keys)


def _write_days(rows: DataFrame, table: str, rollup: Rollup) -> dict[str, dict]:
    return V.write_run(rows, table, F.col(DAY), list(rollup.keys), ("user_id",))


def _gained(spark: SparkSession, source: str, was: dict, now: dict, days: list[str]) -> dict[str, list[dict] | None]:
    """Per day the runs that hold what ``now`` has and ``was`` has not; None where the runs can't tell.

    Where they were merged with older rows since, the versions in between are
    asked, one after the other: a new run is there before it is merged.
    """
    runs = lambda at, day: V.part_of(spark, source, at, day)["runs"]
    out = {day: V.fresh_runs(runs(now, day), runs(was, day)) for day in days}
    unclear = [day for day in days if out[day] is None]
    if unclear:
        try:
            steps = [was, *[V.state(spark, source, number) for number in range(was["number"] + 1, now["number"])], now]
        except Py4JJavaError:  # one of them is gone
            return out
        for day in unclear:
            fresh = [V.fresh_runs(runs(b, day), runs(a, day)) for a, b in zip(steps, steps[1:]) if a["parts"].get(day) != b["parts"].get(day)]
            out[day] = None if None in fresh else [r for some in fresh for r in some]
    return out


def refresh(spark: SparkSession, source: str, table: str, rollup: Rollup, max_runs: int = MAX_RUNS) -> int:
    """Bring the rollup up to the source's newest version; the rollup's version afterwards."""
    ensure_utc(spark)
    while True:
        now, base = V.state(spark, source), V.state(spark, table)
        if now["number"] == base["notes"].get("source", 0):
            return base["number"]
        try:
            was = V.state(spark, source, base["notes"].get("source", 0))
        except Py4JJavaError:  # that version is gone
            was = None
        files = []
        changed = [day for day in {**(was or base)["parts"], **now["parts"]} if was is None or now["parts"].get(day) != was["parts"].get(day)]
        gained = _gained(spark, source, was, now, changed) if was else dict.fromkeys(changed)
        for day, fresh in gained.items():
            files += V.files_of(source, day, V.part_of(spark, source, now, day)["runs"] if fresh is None else fresh)
        schema = V.StructType.fromJson(now["schema"])
        rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
        rows = rollup.partial(_ranged(rollup.keyed(rows), rollup))
        made = _write_days(rows, table, rollup)
        parts: dict[str, dict | None] = {}
        for day in changed:
            kept = [] if gained[day] is None else V.part_of(spark, table, base, day)["runs"]
            runs = kept + ([made[day]] if day in made else [])
            parts[day] = {"runs": runs, "notes": {}} if runs else None
        if V.commit(spark, table, base, parts, rows.schema, {"source": now["number"]}) is not None:
            return merge_runs(spark, table, rollup, list(made), max_runs)


def merge_runs(spark: SparkSession, table: str, rollup: Rollup, days: list[str] | None = None, max_runs: int = MAX_RUNS) -> int:
    """Combine days that have ``max_runs`` runs or more into one run each; the version afterwards."""
    while True:
        base = V.state(spark, table)
        parts = {day: V.part_of(spark, table, base, day) for day in (days or base["parts"])}
        parts = {day: part for day, part in parts.items() if len(part["runs"]) >= max(2, max_runs)}
        if not parts:
            return base["number"]
        rows = V.read(spark, table, base, list(parts))
        made = _write_days(combined(_ranged(rows, rollup), rollup), table, rollup)
        after = {day: part | {"runs": [V.merged_run(made[day], part["runs"])]} for day, part in parts.items()}
        number = V.commit(spark, table, base, after, rows.schema)
        if number is not None:
            return number


def read_rollup(spark: SparkSession, table: str, start: str | None = None, end: str | None = None, user_id: int | None = None) -> DataFrame:
    """Partial rows of the days of a time range; files of other users are not opened.  A key may have several rows."""
    ensure_utc(spark)
    lo, hi = (t[:10] if t else None for t in (start, end))
    rows = V.read(spark, table, parts=lambda day: (lo is None or day >= lo) and (hi is None or day <= hi),
                  keep=lambda z: user_id is None or (z["user_id"][0] is not None and int(z["user_id"][0]) <= user_id <= int(z["user_id"][1])))
    return rows if user_id is None else rows.where(F.col("user_id") == F.lit(user_id))


# --- the dashboards' queries over partial rows --------------------------------

def metric_stats(spark: SparkSession, history: str, slices: str, as_of: str, hours: float = 6, metrics: list[str] = C.CONTEXT_METRICS,
                 user_id: int | None = None) -> DataFrame:
    """A3 over the last ``hours`` from the hourly slice counts (``READING_SLICES``), exact median included.

    Whole hours come from the counts; the history is read for the parts of an
    hour at the window's two ends, and for the rows of the slices that hold a
    median (for one user: that user's files).
    """
    end = dt.datetime.fromisoformat(as_of)
    start, hour = end - dt.timedelta(hours=hours), dt.timedelta(hours=1)
    first = start.replace(minute=0, second=0, microsecond=0)
    first += hour if first < start else dt.timedelta(0)
    after = max(first, end.replace(minute=0, second=0, microsecond=0))  # whole hours are [first, after)
    keys, text = ["user_id", "metric"], lambda t: t.isoformat(sep=" ")

    def raw(a: dt.datetime, b: dt.datetime) -> DataFrame:
        return read_history(spark, history, start=text(a), end=text(b), user_id=user_id).where(F.col("metric").isin(metrics))

    whole = read_rollup(spark, slices, text(first), text(after), user_id).where(
        (F.col("hour") >= F.lit(text(first)).cast("timestamp")) & (F.col("hour") < F.lit(text(after)).cast("timestamp")) & F.col("metric").isin(metrics))
    whole = whole.select(*keys, F.col("slice").alias("_b"), F.col("rows").alias("_all"), F.col("n").alias("_c"), F.col("total").alias("_s"),
                         F.col("low").alias("_lo"), F.col("high").alias("_hi"))
    edges = raw(after, end) if first < end else raw(start, end)
    if start < first < end:
        edges = edges.unionByName(raw(start, first).where(F.col("time") < F.lit(text(first)).cast("timestamp")))
    parts = whole.unionByName(slice_parts(edges, keys, "value")).groupBy(*keys, "_b").agg(
        F.sum("_all").alias("_all"), F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    def kept(spots: DataFrame) -> DataFrame:
        path = scratch_path(spark, "median-spots")
        spots.write.parquet(path)
        return spark.read.schema(spots.schema).parquet(path)

    stats = pick_percentile(raw(start, end), stats_of_parts(parts, keys), keys, "value", 0.5, "median_value", kept)
    return stats.select(*keys, F.col("n_rows").alias("n_samples"), F.col("avg").alias("avg_value"), F.col("min").alias("min_value"),
                        F.col("max").alias("max_value"), "median_value")


def bucket_avg(partials: DataFrame, metric: str, width: str = "1 hour", time_col: str | None = None, start_time: str | None = None) -> DataFrame:
    """A6 / A7 from minutes (or hours, for widths of whole hours)."""
    time_col = time_col or ("minute" if "minute" in partials.columns else "hour")
    win = F.window(time_col, width, startTime=start_time) if start_time else F.window(time_col, width)
    sums = partials.where(F.col("metric") == metric).groupBy("user_id", win.alias("w")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("user_id", F.col("w.start").alias("bucket"), F.try_divide("total", "n").alias("avg_value"))


def alerts_per_minute(partials: DataFrame, severity: str | None = None) -> DataFrame:
    """A9 / A10."""
    if severity is not None:
        partials = partials.where(F.col("severity") == severity)
    return partials.groupBy("user_id", "minute").agg(F.sum("n").alias("n"))


def alert_timeline(partials: DataFrame) -> DataFrame:
    """A11."""
    return partials.groupBy("user_id", "minute", "severity").agg(F.sum("n").alias("n"))


def alert_totals(partials: DataFrame) -> DataFrame:
    """A12."""
    of = [F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in C.SEVERITIES]
    return partials.groupBy("user_id").agg(F.sum("n").alias("total"), *of)


def alerts_by_category(partials: DataFrame) -> DataFrame:
    """A13."""
    return partials.groupBy("user_id", "category").agg(F.sum("n").cast("int").alias("n"))
