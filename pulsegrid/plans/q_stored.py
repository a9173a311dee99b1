"""Registered queries over the tables that the engine's own sinks write.

The histories are written once per session and set of tables, with the K3/K4
projections in the K10 layout, and read back with ``sources.stored``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metrics import get_key_text, has_key_text
from ..operators import aggregates as A
from ..operators import history as H
from ..operators import joins as J
from ..operators import keyed as KY
from ..operators import render as RD
from ..operators import rules as RU
from ..operators.context import flatten_context, user_context
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources import keyed as KD
from ..sources import stored as ST
from ..sources.tables import read_table
from ..streaming import sinks as K
from .catalog import ORACLES, query
from .common import AS_OF, CONTEXT_HOURS, _memo, alerts_of, dates_as_timestamps, readings_of, users_of
from .oracle_views import with_views
from . import q_aggregates, q_history, q_joins, q_keyed, q_render, q_rules  # noqa: F401  their oracles hold here too


def _root(spark, root) -> str:
    """The folder of the written tables: readings and alerts by day, journal, contact links and chat as keyed tables."""
    def write() -> str:
        path = scratch_path(spark, "stored")
        K.layout(K.reading_rows(readings_of(spark, root))).write.partitionBy("event_date").parquet(path + "/readings")
        alerts = K.alert_rows(alerts_of(spark, root))
        K.layout(alerts, order=["user_id", "severity"], time_col="created_at").write.partitionBy("event_date").parquet(path + "/alerts")
        journal = X.journal(spark, root)
        for n in range(5):  # later sequence numbers win whichever comes first; the writes fill two levels
            KD.append(journal.where(F.col("seq") % 5 == n), path + "/journal", KD.JOURNAL, "journal", n, fanout=3)
        KD.append(journal.where(F.col("seq") % 5 == 4), path + "/journal", KD.JOURNAL, "journal", 4)  # a replay
        links = X.contact_links(spark, root)
        for n in range(2):
            KD.append(links.where(F.col("seq") % 2 == n), path + "/contact_links", KD.CONTACT_LINKS, "links", n, fanout=2)
        turns = KY.chat_rows(KY.exchange_to_turns(q_keyed._exchanges(spark, root)))
        for n in range(2):
            KD.append(turns.where(F.pmod(F.xxhash64("row_id"), F.lit(2)) == n), path + "/chat_messages", KD.CHAT, "chat", n)
        return path

    return _memo(spark, root, "stored", write)


def _readings(spark, root):
    return ST.stored_readings(spark, _root(spark, root))


def _alerts(spark, root):
    return ST.stored_alerts(spark, _root(spark, root))


def _numbered(df):
    """The text row id of a stored reading back as the event's number."""
    return df.withColumn("event_id", F.col("event_id").cast("bigint"))


@query("t1_latest_reading_stored", ORACLES["t1_latest_reading"])
def t1_latest_reading_stored(spark, root):
    """T1 on the stored reading history (K3)."""
    return _numbered(H.latest_reading(_readings(spark, root), AS_OF, CONTEXT_HOURS))


@query("t2_recent_alerts_stored", ORACLES["t2_recent_alerts_10"])
def t2_recent_alerts_stored(spark, root):
    """T2 on the stored alert history (K4): newest 10 per user."""
    return _numbered(H.recent_alerts(_alerts(spark, root), 10)).select(
        "user_id", "rn", "created_at", "severity", "category", "title", "text", "event_id", "rule_pos")


@query("t2_recent_alerts_ranged_stored", with_views("""
SELECT user_id, rn, created_at, title, event_id, rule_pos FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC, rule_pos ASC)
             AS INTEGER) AS rn
  FROM alerts WHERE created_at >= TIMESTAMP '2024-01-28 00:00:00' AND created_at <= TIMESTAMP '2024-01-31 00:00:00') t
WHERE rn <= 20
""", "alerts"))
def t2_recent_alerts_ranged_stored(spark, root):
    """T2 with a dashboard's time range on the stored alert history (day partitions pruned)."""
    return _numbered(H.recent_alerts(_alerts(spark, root), 20, AS_OF, 72)).select(
        "user_id", "rn", "created_at", "title", "event_id", "rule_pos")


@query("a4_phase_distribution_stored", ORACLES["a4_phase_distribution"])
def a4_phase_distribution_stored(spark, root):
    """A4 on the stored reading history."""
    return A.phase_distribution(_readings(spark, root), AS_OF, CONTEXT_HOURS)


@query("a5_phase_counts_stored", ORACLES["a5_phase_counts"])
def a5_phase_counts_stored(spark, root):
    """A5 on the stored reading history."""
    return A.phase_counts(_readings(spark, root))


@query("a11_alert_timeline_ranged_stored", with_views("""
SELECT user_id, date_trunc('minute', created_at) AS minute, severity, count(*) AS n FROM alerts
WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL
""", "alerts"))
def a11_alert_timeline_ranged_stored(spark, root):
    """A11 with a dashboard's time range on the stored alert history (day partitions pruned)."""
    return A.alert_timeline(H.in_scope(_alerts(spark, root), start="2024-01-10 00:00:00", end="2024-01-20 00:00:00", time_col="created_at"))


@query("a6_hr_trend_ranged_stored", with_views("""
SELECT user_id, date_trunc('hour', event_time) AS bucket, round(avg(value) + 1e-9, 6) AS avg_value FROM readings
WHERE metric = 'heart_rate' AND event_time >= TIMESTAMP '2024-01-10 00:00:00' AND event_time <= TIMESTAMP '2024-01-20 00:00:00'
GROUP BY ALL
""", "readings"))
def a6_hr_trend_ranged_stored(spark, root):
    """A6 with a dashboard's time range on the stored reading history (day partitions pruned, metric pushed)."""
    scoped = H.in_scope(_readings(spark, root), start="2024-01-10 00:00:00", end="2024-01-20 00:00:00")
    return q_aggregates._rounded(A.bucket_avg(scoped, "heart_rate", "1 hour"))


@query("r6_detect_alerts_stored", ORACLES["r6_detect_alerts"])
def r6_detect_alerts_stored(spark, root):
    """R6 on the stored reading history (rule guards pushed to its Parquet files)."""
    return _numbered(RU.detect_alerts(_readings(spark, root), created_at=F.col("event_time"), keep=["event_id"]))


def _context(spark, root):
    path = _root(spark, root)
    return user_context(users_of(spark, root), _readings(spark, root), _alerts(spark, root), ST.stored_journal(spark, path), AS_OF, CONTEXT_HOURS)


@query("j3_user_context_flat_stored", ORACLES["j3_user_context_flat"])
def j3_user_context_flat_stored(spark, root):
    """J3 from the stored readings, alerts and journal."""
    return dates_as_timestamps(flatten_context(_context(spark, root)))


@query("f2_context_markdown_stored", ORACLES["f2_context_markdown"])
def f2_context_markdown_stored(spark, root):
    """F2 from the stored tables' context."""
    ctx = _context(spark, root)
    return ctx.select("user_id", RD.context_markdown(ctx).alias("markdown"))


@query("f1_alert_message_stored", ORACLES["f1_alert_message"])
def f1_alert_message_stored(spark, root):
    """F1 from the stored alert history."""
    a = _numbered(_alerts(spark, root))
    return a.select("event_id", "rule_pos", RD.alert_message(a).alias("message"))


@query("c2_metadata_text", ORACLES["c2_metadata_keys"])
def c2_metadata_text(spark, root):
    """C2 on the history's JSON text: key test and extraction."""
    rows = read_table(spark, _root(spark, root), "readings")
    return rows.select(F.col("row_id").cast("bigint").alias("event_id"), has_key_text("metadata", "phase").alias("has_phase"),
                       get_key_text("metadata", "phase").alias("phase"))


@query("k7_journal_stored", ORACLES["k7_upsert_journal"])
def k7_journal_stored(spark, root):
    """K7 written: the journal of five writes and a replay, read as one row per (user, date)."""
    rows = ST.stored_journal(spark, _root(spark, root))
    return dates_as_timestamps(rows.select("user_id", "entry_date", "seq", *KY.JOURNAL_VALUES, "created_at"))


@query("k8_links_stored", ORACLES["k8_link_contacts"])
def k8_links_stored(spark, root):
    """K8 written: users with their last contact id of two writes of links."""
    return ST.stored_users(spark, users_of(spark, root), _root(spark, root)).select("user_id", "contact_id")


@query("k7_user_journal", with_views("""
SELECT entry_date_ts AS entry_date, seq, mood, notes, created_at FROM (
  SELECT CAST(entry_date AS TIMESTAMP) AS entry_date_ts, *  EXCLUDE (created_at), min(created_at) OVER (PARTITION BY user_id, entry_date) AS created_at,
         row_number() OVER (PARTITION BY user_id, entry_date ORDER BY seq DESC) AS rn FROM journal WHERE user_id = 7) t
WHERE rn = 1
""", "journal"))
def k7_user_journal(spark, root):
    """K7 written: one user's journal; files whose users lie elsewhere are not opened."""
    return dates_as_timestamps(ST.stored_journal(spark, _root(spark, root), user_id=7).select("entry_date", "seq", "mood", "notes", "created_at"))


@query("t4_chat_history_stored", with_views("""
SELECT user_id, role, content, created_at, rn, count(*) OVER (PARTITION BY user_id) - rn + 1 AS position FROM (
  SELECT user_id, role, content, created_at, CAST(row_number() OVER (PARTITION BY user_id
           ORDER BY created_at DESC, session DESC, pos DESC) AS INTEGER) AS rn
  FROM (SELECT g.user_id, g.created_at, md5(CAST(user_id AS VARCHAR) || ':' || CAST(conv_id * 1000 + pair AS VARCHAR)) AS session,
               r.pos, r.role, CASE WHEN r.pos = 0 THEN g.message ELSE g.reply END AS content
        FROM (SELECT user_id, conv_id, turn // 2 AS pair, max(CASE WHEN role = 'user' THEN content END) AS message,
                     max(CASE WHEN role = 'assistant' THEN content END) AS reply, min(created_at) AS created_at
              FROM chat_turns GROUP BY ALL) g, (SELECT 0 AS pos, 'user' AS role UNION ALL SELECT 1, 'assistant') r(pos, role)) m
  WHERE content IS NOT NULL) t
WHERE rn <= 50
""", "chat_turns"))
def t4_chat_history_stored(spark, root):
    """K9 written + T4: the stored chat messages, last 50 per user."""
    return H.chat_history(ST.stored_chat(spark, _root(spark, root)), 50).select(
        "user_id", "role", "content", "created_at", "rn", "position")


@query("j1_route_alerts_stored", ORACLES["j1_route_alerts"])
def j1_route_alerts_stored(spark, root):
    """J1 from the stored alert history."""
    return _numbered(J.route_alerts(_alerts(spark, root), users_of(spark, root))).select(
        "user_id", "event_id", "rule_pos", "severity", "contact_id")
