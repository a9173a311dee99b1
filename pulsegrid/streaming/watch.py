"""R9 on a stream without waiting for the watermark: minute averages kept as state, flagged as soon as they pass the limit.

The windowed R9 (``rules.hr_watch``) gives a minute once the watermark has closed it, a minute or more
after it ended.  Here a minute's running sums are state, and two kinds of rows come out:

* ``early``: in the micro-batch whose readings bring a user's minute above the limit;
* ``closed``: when the watermark has passed the minute: its final figures, equal to the batch R9's.
  ``flagged`` tells whether the early row, if there was one, holds.

A user's minute gives one early row.  With ``rearm`` a minute that fell to that average or below since may
give another.

Readings are summed per (user, minute) in the tasks that read them, so the state operator gets a row a user
and minute from each task, not a user's readings.  State is kept by bucket of users: its cost goes with the
rows, not with calls for each user and minute.  (Checkpoints from before that are of another shape: such a
watch begins a new one.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..session import DEFAULT_CONF

MINUTE_US = 60_000_000
PARTIAL = "user_id bigint, minute bigint, n bigint, total double, high double, event_time timestamp"
OUTPUT = "user_id bigint, window_start timestamp, kind string, avg_hr double, max_hr double, n_samples bigint, flagged boolean"


def minute_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user_id, event_time, value) -> a row a user and minute: count, sum, maximum, and the newest time (which moves the watermark)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        us = batch.column("event_time").cast(pa.int64())
        minute = pc.divide(us, MINUTE_US)  # times before 1970 are not readings
        rows = pa.table({"user_id": batch.column("user_id"), "minute": minute, "value": batch.column("value"), "event_time": batch.column("event_time")})
        sums = rows.group_by(["user_id", "minute"]).aggregate([("value", "count"), ("value", "sum"), ("value", "max"), ("event_time", "max")])
        out = pa.table({"user_id": sums["user_id"], "minute": sums["minute"], "n": sums["value_count"],
                        "total": pc.fill_null(sums["value_sum"], 0.0), "high": sums["value_max"], "event_time": sums["event_time_max"]})
        yield from out.to_batches()


HELD = ["user_id", "minute", "n", "total", "high", "armed"]
STATE = "user_id array<bigint>, minute array<bigint>, n array<bigint>, total array<double>, high array<double>, armed array<boolean>"
KINDS = {"minute": "int64", "n": "int64", "total": "float64", "high": "float64", "armed": "bool"}
BUCKETS = 256
NO_USER = -1  # the bucket of those without an id


def _average(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Per minute; NaN where it has no value."""
    return np.divide(rows["total"], rows["n"], out=np.full(len(rows["n"]), np.nan), where=rows["n"] > 0)


def _by_minute(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row a user and minute: sums, the maximum (NaN: none), whether all are armed and whether any came now."""
    order = np.lexsort((rows["minute"], rows["user_id"]))
    user, minute = rows["user_id"][order], rows["minute"][order]
    at = np.flatnonzero(np.r_[True, (user[1:] != user[:-1]) | (minute[1:] != minute[:-1])])
    total = np.nan_to_num(rows["total"][order], nan=0.0, posinf=np.inf, neginf=-np.inf)
    return {"user_id": user[at], "minute": minute[at], "n": np.add.reduceat(rows["n"][order], at), "total": np.add.reduceat(total, at),
            "high": np.fmax.reduceat(rows["high"][order], at), "armed": np.logical_and.reduceat(rows["armed"][order], at),
            "came": np.logical_or.reduceat(rows["came"][order], at)}


class MinuteWatch(StatefulProcessor):
    """Per bucket of users: the open minutes (user, minute, n, total, high, armed) as arrays, and a timer at the end of the earliest.

    A batch reads and writes a bucket's minutes in one step and works on them
    as columns; a call, a timer or a state access for each user's minute would
    cost more than the sums do.  Users without an id have a bucket of their own.
    """

    def __init__(self, limit: float, rearm: float | None) -> None:
        self.limit, self.rearm = limit, rearm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getValueState("minutes", STATE)

    def _held(self, null: bool) -> dict[str, np.ndarray]:
        return self._columns(dict(zip(HELD, self.minutes.get() if self.minutes.exists() else [[]] * len(HELD))), null)

    def _columns(self, values: dict, null: bool) -> dict[str, np.ndarray]:
        """As arrays; in the bucket of users without an id the id is 0 here (another bucket's ids are whole numbers, not to be made floats)."""
        users = np.zeros(len(values["minute"]), "int64") if null else np.asarray(values["user_id"], "int64")
        return {"user_id": users} | {c: np.asarray(values[c], kind) for c, kind in KINDS.items()}

    def _hold(self, rows: dict[str, np.ndarray], null: bool, timer: bool = True) -> None:
        """Keep these minutes, with a timer at the end of the earliest (``timer``: unless it has one)."""
        n = len(rows["minute"])
        if not n:
            self.minutes.clear()
            return
        values = {c: rows[c].tolist() for c in HELD}
        self.minutes.update(tuple([None] * n if c == "user_id" and null else [None if v != v else v for v in values[c]] for c in HELD))
        if timer:
            at = (int(rows["minute"].min()) + 1) * MINUTE_US // 1000
            if at not in set(self.handle.listTimers()):
                self.handle.registerTimer(at)

    def _rows(self, rows: dict[str, np.ndarray], which: np.ndarray, kind: str, null: bool) -> Iterator[pd.DataFrame]:
        own = {c: rows[c][which] for c in ("user_id", "minute", "n", "total", "high")}
        avg = _average(own)
        flagged = pd.Series(avg > self.limit).astype("boolean").where(pd.Series(~np.isnan(avg)))
        yield pd.DataFrame({"user_id": [None] * len(avg) if null else own["user_id"], "window_start": pd.to_datetime(own["minute"] * MINUTE_US, unit="us"),
                            "kind": kind, "avg_hr": avg, "max_hr": own["high"], "n_samples": own["n"], "flagged": flagged})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        null, frames = key[0] == NO_USER, list(rows)
        size = sum(map(len, frames))
        came = self._columns({c: np.concatenate([f[c].to_numpy() for f in frames]) for c in ("user_id", "minute", "n", "total", "high")} | {"armed": np.ones(size)}, null)
        held = self._held(null)
        both = {c: np.concatenate([held[c], came[c]]) for c in HELD} | {"came": np.arange(len(held["minute"]) + size) >= len(held["minute"])}
        one = _by_minute(both)
        avg = np.where(one["n"] > 0, _average(one), 0.0)
        early = one["came"] & (one["n"] > 0) & one["armed"] & (avg > self.limit)
        again = one["came"] & ~early & (avg <= self.rearm) if self.rearm is not None else False
        one["armed"] = (one["armed"] & ~early) | again
        self._hold(one, null, timer=not len(held["minute"]) or one["minute"].min() < held["minute"].min())
        yield from self._rows(one, early, "early", null)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        null = key[0] == NO_USER
        held, came = self._held(null), self._columns({c: initialState[c].to_numpy() for c in HELD}, null)
        self._hold({c: np.concatenate([held[c], came[c]]) for c in HELD}, null)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        null = key[0] == NO_USER
        held = self._held(null)
        over = (held["minute"] + 1) * MINUTE_US // 1000 <= timerValues.getCurrentWatermarkInMs()
        if over.any():
            self._hold({c: v[~over] for c, v in held.items()}, null)
        yield from self._rows(held, over, "closed", null)

    def close(self) -> None:
        pass


def open_minutes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The minutes that a watch's checkpoint holds open: user_id, minute, n, total, high, armed, and the state's partition.

    Read with Spark's state data source, also while the query runs.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "minutes").load()
    return state.select("partition_id", F.inline(F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in HELD]))).select(*HELD, "partition_id")


def early_watch(readings: DataFrame, delay: str = C.WATERMARK_DELAY, limit: float = C.HR_WATCH_LIMIT, rearm: float | None = None,
                initial: DataFrame | None = None) -> DataFrame:
    """R9 with early rows, over a stream of readings.

    ``initial`` (``open_minutes`` of a stopped query, written to a table) are
    minutes to go on with: that is how a watch moves to another shuffle width,
    which a checkpoint fixes.  The new query gets a checkpoint of its own and
    the readings from where the old one stopped.

    The state operator needs the RocksDB state store: a session with another
    one is switched for the queries it starts from here on (started queries and
    old checkpoints keep theirs).
    """
    conf, key = readings.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if conf.get(key) != DEFAULT_CONF[key]:
        conf.set(key, DEFAULT_CONF[key])
    hr = readings.where(F.col("metric") == "heart_rate").select(
        F.col("user_id").cast("bigint").alias("user_id"), F.col("event_time").cast("timestamp").alias("event_time"), F.col("value").cast("double").alias("value"))
    bucket = F.when(F.col("user_id").isNull(), NO_USER).otherwise(F.pmod(F.xxhash64(F.col("user_id").cast("bigint")), F.lit(BUCKETS))).cast("int").alias("bucket")
    sums = hr.mapInArrow(minute_sums, PARTIAL).withWatermark("event_time", delay).select("*", bucket)
    held = None if initial is None else initial.select(*HELD, bucket).groupBy("bucket")
    return sums.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=MinuteWatch(limit, rearm), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", initialState=held)
