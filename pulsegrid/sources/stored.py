"""The tables that the sinks write, in the shape the operators read.

Histories (K3, K4) keep the metadata as JSON text and a text row id; here the
map, the alert fields and ``event_id`` come back, and the day column stays, so
time scopes prune partitions.  Keyed tables (K7-K9) come back with their last
state per key; with ``user_id`` only that user's files are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.joins import link_contacts
from . import keyed
from .tables import path_exists, read_table


def history_rows(spark: SparkSession, root: str, name: str, **scope) -> DataFrame:
    """A history's rows: a versioned table's newest version (with the scope of ``compaction.read_history``), else a plain folder."""
    from ..streaming.compaction import read_history
    if path_exists(spark, f"{root}/{name}/versions"):
        return read_history(spark, f"{root}/{name}", **scope)
    if scope:
        raise ValueError("a scope needs a versioned history")
    return read_table(spark, root, name)


def stored_readings(spark: SparkSession, root: str, name: str = "readings", **scope) -> DataFrame:
    """K3 rows as decoded readings."""
    rows = history_rows(spark, root, name, **scope)
    return rows.select(
        F.col("row_id").alias("event_id"), "user_id", F.col("time").alias("event_time"), "metric", "value",
        F.col("source").alias("source_name"), F.from_json("metadata", "map<string,string>").alias("metadata"), "event_date")


def stored_alerts(spark: SparkSession, root: str, name: str = "alerts", **scope) -> DataFrame:
    """K4 rows as alerts."""
    rows = history_rows(spark, root, name, **scope)
    extra = F.from_json("metadata", "metric string, value double, phase string")
    return rows.withColumn("m", extra).select(
        "user_id", "created_at", "severity", "category", "title", "text", "m.metric", "m.value", "m.phase",
        F.col("row_id").alias("event_id"), "rule_pos", "event_date")


def stored_journal(spark: SparkSession, root: str, name: str = "journal", user_id: int | None = None) -> DataFrame:
    """K7: one journal row per (user, date)."""
    return keyed.read(spark, f"{root}/{name}", keyed.JOURNAL, user_id)


def stored_users(spark: SparkSession, users: DataFrame, root: str, name: str = "contact_links") -> DataFrame:
    """K8: users with their last contact ids."""
    updated, _ = link_contacts(users, keyed.read(spark, f"{root}/{name}", keyed.CONTACT_LINKS))
    return updated


def stored_chat(spark: SparkSession, root: str, name: str = "chat_messages", user_id: int | None = None) -> DataFrame:
    """K9: chat messages (``schemas.CHAT_MESSAGES``)."""
    return keyed.read(spark, f"{root}/{name}", keyed.CHAT, user_id).select(*S.CHAT_MESSAGES.fieldNames())
