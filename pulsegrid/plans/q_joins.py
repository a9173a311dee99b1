"""Registered join queries (J1-J5, K8) and the context snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import joins as J
from ..operators.context import flatten_context, user_context
from ..sources import fixtures as X
from .catalog import query
from .common import AS_OF, CONTEXT_HOURS, alerts_of, dates_as_timestamps, readings_of, users_of
from .oracle_views import AS_OF as SQL_AS_OF
from .oracle_views import with_views


@query("j1_route_alerts", with_views("""
SELECT a.user_id, a.event_id, a.rule_pos, a.severity, u.contact_id
FROM alerts a LEFT JOIN users u ON a.user_id = u.user_id WHERE a.user_id IS NOT NULL
""", "alerts", "users"))
def j1_route_alerts(spark, root):
    """Each alert with its user's contact id (left: alerts without a contact are kept)."""
    routed = J.route_alerts(alerts_of(spark, root), users_of(spark, root), "left")
    return routed.select("user_id", "event_id", "rule_pos", "severity", "contact_id")


@query("j1_deliverable_alerts", with_views("""
SELECT a.user_id, a.event_id, a.rule_pos, u.contact_id
FROM alerts a JOIN users u ON a.user_id = u.user_id WHERE u.contact_id IS NOT NULL
""", "alerts", "users"))
def j1_deliverable_alerts(spark, root):
    """Alerts that can go to the chat channel (inner join, contact present)."""
    routed = J.route_alerts(alerts_of(spark, root), users_of(spark, root), "inner")
    return routed.select("user_id", "event_id", "rule_pos", "contact_id")


@query("j1_route_as_of", with_views("""
SELECT a.user_id, a.event_id, a.rule_pos, a.created_at, l.contact_id
FROM alerts a ASOF LEFT JOIN (
  SELECT user_id, linked_at, arg_max(contact_id, seq) AS contact_id FROM (
    SELECT *, TIMESTAMP '2024-01-01 00:00:00' + (seq * 7919 % 40320) * INTERVAL 1 MINUTE AS linked_at FROM contact_links) t GROUP BY ALL) l
ON a.user_id = l.user_id AND a.created_at >= l.linked_at
WHERE a.user_id IS NOT NULL
""", "alerts", "contact_links"))
def j1_route_as_of(spark, root):
    """J1 + K8: each alert with the contact that was linked when it was raised; links recorded in no order of time."""
    links = X.contact_links(spark, root).withColumn(
        "linked_at", F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("seq") * 7919 % 40320).cast("int")))
    routed = J.route_alerts_as_of(alerts_of(spark, root), links)
    return routed.select("user_id", "event_id", "rule_pos", "created_at", "contact_id")


@query("j2_lookup_users", with_views("""
SELECT r.user_id, u.email, u.name, u.chronotype, u.timezone, u.contact_id, u.user_id IS NOT NULL AS found
FROM (SELECT DISTINCT user_id FROM readings) r LEFT JOIN users u ON r.user_id = u.user_id
""", "readings", "users"))
def j2_lookup_users(spark, root):
    """User lookup for every user id seen in the readings; found = false when missing."""
    ids = readings_of(spark, root).select("user_id").distinct()
    return J.lookup_users(ids, users_of(spark, root))


ALERT_SCOPE = f"created_at >= {SQL_AS_OF} - INTERVAL {CONTEXT_HOURS} HOUR AND created_at <= {SQL_AS_OF}"
READ_SCOPE = f"event_time >= {SQL_AS_OF} - INTERVAL {CONTEXT_HOURS} HOUR AND event_time <= {SQL_AS_OF}"
METRICS_IN = ", ".join(f"'{m}'" for m in C.CONTEXT_METRICS)


@query("j3_user_context_flat", with_views(f"""
SELECT ids.user_id, u.name, u.chronotype,
       CAST(coalesce(st.n_metrics, 0) AS INTEGER) AS n_metrics, coalesce(st.hr_n, 0) AS hr_n,
       CAST(coalesce(ph.n_stages, 0) AS INTEGER) AS n_stages,
       CAST(coalesce(al.n_alerts, 0) AS INTEGER) AS n_alerts, al.newest_alert_title,
       CAST(jr.entry_date AS TIMESTAMP) AS journal_date, jr.mood AS journal_mood
FROM ids
LEFT JOIN users u ON ids.user_id = u.user_id
LEFT JOIN st ON ids.user_id = st.user_id
LEFT JOIN ph ON ids.user_id = ph.user_id
LEFT JOIN al ON ids.user_id = al.user_id
LEFT JOIN jr ON ids.user_id = jr.user_id
""", "readings", "alerts", "users", "journal", ctes=f"""
st AS (SELECT user_id, count(DISTINCT metric) AS n_metrics, count(*) FILTER (WHERE metric = 'heart_rate') AS hr_n0,
              CASE WHEN count(*) FILTER (WHERE metric = 'heart_rate') > 0
                   THEN count(*) FILTER (WHERE metric = 'heart_rate') END AS hr_n
       FROM readings WHERE {READ_SCOPE} AND metric IN ({METRICS_IN}) GROUP BY user_id),
ph AS (SELECT user_id, count(DISTINCT string_split(phase, 'Analysis')[-1]) AS n_stages FROM readings WHERE {READ_SCOPE} AND phase IS NOT NULL
       GROUP BY user_id),
ar AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC, rule_pos) AS rn
       FROM alerts WHERE {ALERT_SCOPE}),
al AS (SELECT user_id, least(count(*), 10) AS n_alerts, max(CASE WHEN rn = 1 THEN title END) AS newest_alert_title
       FROM ar GROUP BY user_id),
jr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY entry_date DESC, seq DESC) AS rn
       FROM journal) t WHERE rn = 1),
ids AS (SELECT user_id FROM users UNION SELECT user_id FROM st UNION SELECT user_id FROM ph
        UNION SELECT user_id FROM al UNION SELECT user_id FROM jr)"""))
def j3_user_context_flat(spark, root):
    """The context snapshot for every user, checked through its scalar parts."""
    return dates_as_timestamps(flatten_context(_context(spark, root)))


def _context(spark, root):
    return user_context(users_of(spark, root), readings_of(spark, root), alerts_of(spark, root),
                        X.journal(spark, root), AS_OF, CONTEXT_HOURS)


@query("j3_user_context")
def j3_user_context(spark, root):
    """One nested context row per user (user, biometrics, sleep phases, alerts, journal)."""
    return _context(spark, root)


@query("j4_orphan_readings", with_views("""
SELECT r.event_id, r.user_id FROM readings r WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id)
""", "readings", "users"))
def j4_orphan_readings(spark, root):
    """Readings whose user does not exist (anti join)."""
    return J.orphans(readings_of(spark, root), users_of(spark, root)).select("event_id", "user_id")


@query("j4_known_alerts", with_views("""
SELECT a.event_id, a.rule_pos FROM alerts a WHERE EXISTS (SELECT 1 FROM users u WHERE u.user_id = a.user_id)
""", "alerts", "users"))
def j4_known_alerts(spark, root):
    """Alerts whose user exists (semi join)."""
    return J.known(alerts_of(spark, root), users_of(spark, root)).select("event_id", "rule_pos")


@query("j4_orphan_journal", with_views("""
SELECT j.seq, j.user_id FROM journal j WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = j.user_id)
""", "journal", "users"))
def j4_orphan_journal(spark, root):
    """Journal entries whose user does not exist."""
    return J.orphans(X.journal(spark, root), users_of(spark, root)).select("seq", "user_id")


@query("j4_orphan_links", with_views("""
SELECT l.seq, l.user_id FROM contact_links l WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = l.user_id)
""", "users", "contact_links"))
def j4_orphan_links(spark, root):
    """Contact updates whose user does not exist."""
    return J.orphans(X.contact_links(spark, root), users_of(spark, root)).select("seq", "user_id")


@query("j5_duplicate_emails", with_views(
    "SELECT email, count(*) AS n FROM users GROUP BY email HAVING count(*) > 1", "users"))
def j5_duplicate_emails(spark, root):
    """E-mail uniqueness violations."""
    return J.duplicates(users_of(spark, root), ["email"])


@query("j5_duplicate_journal_days", with_views(
    "SELECT user_id, CAST(entry_date AS TIMESTAMP) AS entry_date, count(*) AS n FROM journal "
    "GROUP BY user_id, entry_date HAVING count(*) > 1",
    "journal"))
def j5_duplicate_journal_days(spark, root):
    """(user, date) uniqueness violations in the raw journal."""
    return dates_as_timestamps(J.duplicates(X.journal(spark, root), ["user_id", "entry_date"]))


@query("k8_link_contacts", with_views("""
SELECT u.user_id, coalesce(l.contact_id, u.contact_id) AS contact_id
FROM users u LEFT JOIN (SELECT user_id, arg_max(contact_id, seq) AS contact_id FROM contact_links GROUP BY user_id) l
  ON u.user_id = l.user_id
""", "users", "contact_links"))
def k8_link_contacts(spark, root):
    """K8: contact-id updates applied by user id."""
    updated, _ = J.link_contacts(users_of(spark, root), X.contact_links(spark, root))
    return updated.select("user_id", "contact_id")


@query("k8_unknown_links", with_views("""
SELECT l.user_id, arg_max(l.contact_id, l.seq) AS contact_id FROM contact_links l
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = l.user_id) GROUP BY l.user_id
""", "users", "contact_links"))
def k8_unknown_links(spark, root):
    """K8: updates naming users that do not exist."""
    _, unknown = J.link_contacts(users_of(spark, root), X.contact_links(spark, root))
    return unknown
