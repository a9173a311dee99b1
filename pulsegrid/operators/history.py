"""History queries: scoping predicates, latest values, newest-N lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.topk import latest, top_n
from .aggregates import since


def in_scope(df: DataFrame, user_id=None, start=None, end=None, metrics: list[str] | None = None,
             severity: str | None = None, time_col: str = "event_time", date_col: str = "event_date") -> DataFrame:
    """User equality, time range ``[start, end]``, metric IN-list, severity equality.

    Plain column predicates: Catalyst pushes them into the Parquet scan; on a
    day-partitioned history the range is repeated on the day column so whole
    partitions are pruned.
    """
    cond = F.lit(True)
    has_day = date_col in df.columns
    if user_id is not None:
        cond = cond & (F.col("user_id") == F.lit(user_id))
    if start is not None:
        cond = cond & (F.col(time_col) >= F.lit(start).cast("timestamp"))
        if has_day:
            cond = cond & (F.col(date_col) >= F.to_date(F.lit(start).cast("timestamp")))
    if end is not None:
        cond = cond & (F.col(time_col) <= F.lit(end).cast("timestamp"))
        if has_day:
            cond = cond & (F.col(date_col) <= F.to_date(F.lit(end).cast("timestamp")))
    if metrics is not None:
        cond = cond & F.col("metric").isin(list(metrics))
    if severity is not None:
        cond = cond & (F.col("severity") == F.lit(severity))
    return df.where(cond)


def latest_reading(df: DataFrame, as_of=None, hours: float | None = None,
                   metrics: list[str] = ("heart_rate", "hrv", "oxygen", "temperature"),
                   time_col: str = "event_time") -> DataFrame:
    """Latest reading per user and metric in the range (ties: highest event id)."""
    scoped = since(df, as_of, hours, time_col).where(F.col("metric").isin(list(metrics)))
    return latest(scoped, ["user_id", "metric"], [time_col, "event_id"], ["value"])


def recent_alerts(alerts: DataFrame, n: int = 10, as_of=None, hours: float | None = None,
                  order: list[Column] | None = None) -> DataFrame:
    """Newest ``n`` alerts per user (``rn`` = 1 is the newest).

    Default order: created_at desc, then source event and rule position, so
    the cut is deterministic.
    """
    scoped = since(alerts, as_of, hours, "created_at")
    order = order or [F.col("created_at").desc(), F.col("event_id").desc(), F.col("rule_pos").asc()]
    return top_n(scoped, ["user_id"], order, n)


def latest_journal(journal: DataFrame) -> DataFrame:
    """Latest journal entry per user (by entry date, then sequence)."""
    values = ["mood", "stress_level", "caffeine_after_17", "alcohol", "screens_min_before_bed", "notes"]
    return latest(journal, ["user_id"], ["entry_date", "seq"], values)


def chat_history(turns: DataFrame, n: int = 50, ties: tuple[str, ...] | None = None) -> DataFrame:
    """T4: last ``n`` messages per user with ``rn`` (1 = newest) and ``position`` (1 = oldest of them).

    Messages of one time are ordered by ``ties`` (the stored table's ``row_id``,
    or conversation and turn).

    ``position`` gives the oldest-first order the chat history is shown in
    without a global sort; sort by (user_id, position) only when presenting.
    """
    ties = ties or (("row_id",) if "row_id" in turns.columns else ("conv_id", "turn"))
    ranked = top_n(turns, ["user_id"], [F.col(c).desc() for c in ("created_at", *ties)], n)
    kept = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return ranked.withColumn("position", kept - F.col("rn") + 1)


def stage_order(distribution: DataFrame) -> DataFrame:
    """T5: each user's stages by percent, descending, then by name: (user_id, position, stage, pct).

    The few stages of a user are sorted as one array; ``distribution`` is A4's result.
    """
    by_share = distribution.groupBy("user_id").agg(F.array_sort(
        F.collect_list(F.struct((-F.col("pct")).alias("key"), "stage", "pct"))).alias("stages"))
    placed = by_share.select("user_id", F.posexplode("stages").alias("pos", "s"))
    return placed.select("user_id", (F.col("pos") + 1).alias("position"), "s.stage", "s.pct")
