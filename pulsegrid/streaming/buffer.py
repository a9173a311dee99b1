"""T6 on a stream: every user's newest alerts as state, at most n of them, for as long as they are wanted.

A micro-batch with alerts of a user puts out the user's whole buffer again; ``latest_buffers`` keeps the
newest one of each.  What the buffer holds does not depend on how alerts were dealt to batches, nor on
alerts that came twice.  Tasks send at most n alerts a user to the state operator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import DEFAULT_CONF

FIELDS = ["created_at", "severity", "category", "title", "text", "event_id", "rule_pos"]
SCHEMA = "created_at timestamp, severity string, category string, title string, text string, event_id string, rule_pos int"

ROW = Row("user_id", "rn", *FIELDS)


def newest(alerts: Iterable[tuple], n: int) -> list[tuple]:
    """The first n (tuples of ``FIELDS``) by time descending, event id descending, rule position, nulls last; an alert counts once."""
    once: dict = {}
    for a in alerts:
        once.setdefault((a[5], a[6]), a)
    kept = sorted(once.values(), key=lambda a: a[6])
    kept.sort(key=lambda a: (a[5] is not None, a[5] or ""), reverse=True)
    kept.sort(key=lambda a: (a[0] is not None, a[0] or datetime.min), reverse=True)
    return kept[:n]


def newest_of_each(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Of every frame at most n alerts a user, by the order of ``newest``: one sort a frame, however many users it has."""
    for frame in frames:
        once = frame.drop_duplicates(["user_id", "event_id", "rule_pos"])
        once = once.sort_values(["user_id", "created_at", "event_id", "rule_pos"], ascending=[True, False, False, True], kind="stable")
        yield once.groupby("user_id", sort=False).head(n)


class AlertBuffer(StatefulProcessor):
    """Per user: a list state of at most n alerts with a time-to-live.

    Works on plain rows: a user brings a few of them to a batch, and a data
    frame a user would cost far more than the rows do.
    """

    def __init__(self, n: int, ttl_ms: int | None) -> None:
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerts = handle.getListState("alerts", SCHEMA, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = ((r.created_at and r.created_at.astimezone(UTC).replace(tzinfo=None), *(r[f] for f in FIELDS[1:])) for r in rows)
        kept = newest([*map(tuple, self.alerts.get()), *came], self.n)  # the state's times have no zone, the rows' have
        self.alerts.put(kept)
        for rn, (at, *rest) in enumerate(kept, 1):
            yield ROW(key[0], rn, at and at.replace(tzinfo=UTC), *rest)

    def close(self) -> None:
        pass


def alert_buffers(alerts: DataFrame, n: int = 100, ttl_days: int | None = None) -> DataFrame:
    """(user_id, rn, alert fields) of every user that a micro-batch has alerts of; alerts without a user have no buffer.

    With ``ttl_days`` a user's state goes when nothing came for so long.  That
    is measured on the clock, so such a query runs batches without end: not
    with ``availableNow``.
    """
    conf, key = alerts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if conf.get(key) != DEFAULT_CONF[key]:
        conf.set(key, DEFAULT_CONF[key])

    columns = f"user_id bigint, {SCHEMA}"
    typed = alerts.where("user_id IS NOT NULL").select(
        F.col("user_id").cast("bigint").alias("user_id"), *[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")])
    ttl_ms = ttl_days * 86_400_000 if ttl_days else None
    return typed.mapInPandas(lambda frames: newest_of_each(frames, n), columns).groupBy("user_id").transformWithState(
        statefulProcessor=AlertBuffer(n, ttl_ms), outputStructType=f"user_id bigint, rn int, {SCHEMA}", outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None")


def latest_buffers(rows: DataFrame) -> DataFrame:
    """Of what the batches wrote (with ``batch_id``) every user's newest buffer."""
    newest_batch = rows.groupBy("user_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest_batch, ["user_id", "batch_id"]).drop("batch_id", "writer_id")
