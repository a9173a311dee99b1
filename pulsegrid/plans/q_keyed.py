"""Registered keyed-write and validation queries (K7, K9, C5, C6) and source scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import keyed as K
from ..session import scratch_path
from ..sources import fixtures as X
from ..sources.survey import read_survey, write_survey_csv
from .catalog import query
from .common import dates_as_timestamps, readings_of, users_of
from .oracle_views import with_views


def _journal_halves(spark, root):
    j = X.journal(spark, root)
    return j.where(F.col("seq") % 2 == 0), j.where(F.col("seq") % 2 == 1)


@query("k7_upsert_journal", with_views("""
SELECT user_id, CAST(entry_date AS TIMESTAMP) AS entry_date, seq, mood, stress_level, caffeine_after_17, alcohol,
       screens_min_before_bed, notes, first_created AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, entry_date ORDER BY seq DESC) AS rn,
             min(created_at) OVER (PARTITION BY user_id, entry_date) AS first_created FROM journal) t
WHERE rn = 1
""", "journal"))
def k7_upsert_journal(spark, root):
    """K7: upsert of new journal entries into a base on (user, date): last values win, first created_at kept."""
    base, new = _journal_halves(spark, root)
    return dates_as_timestamps(K.upsert_journal(base, new))


def _exchanges(spark, root):
    """Chat exchanges: a user turn and the assistant turn after it, from the chat turns."""
    t = X.chat_turns(spark, root)
    pair = F.floor(F.col("turn") / 2)
    return t.groupBy("user_id", "conv_id", pair.alias("pair")).agg(
        F.max(F.when(F.col("role") == "user", F.col("content"))).alias("message"),
        F.max(F.when(F.col("role") == "assistant", F.col("content"))).alias("reply"),
        F.min("created_at").alias("created_at")).select(
        "user_id", (F.col("conv_id") * 1000 + F.col("pair")).alias("exchange_id"), "message", "reply", "created_at")


@query("k9_exchange_to_turns", with_views("""
SELECT user_id, exchange_id, pos, role, content, created_at,
       md5(CAST(user_id AS VARCHAR) || ':' || CAST(exchange_id AS VARCHAR)) AS session_id
FROM (SELECT user_id, conv_id * 1000 + pair AS exchange_id, message, reply, created_at FROM (
        SELECT user_id, conv_id, turn // 2 AS pair,
               max(CASE WHEN role = 'user' THEN content END) AS message,
               max(CASE WHEN role = 'assistant' THEN content END) AS reply, min(created_at) AS created_at
        FROM chat_turns GROUP BY ALL) g) e,
     (SELECT 0 AS pos, 'user' AS role UNION ALL SELECT 1, 'assistant') r(pos, role)
CROSS JOIN LATERAL (SELECT CASE WHEN r.pos = 0 THEN e.message ELSE e.reply END AS content) c
WHERE content IS NOT NULL
""", "chat_turns"))
def k9_exchange_to_turns(spark, root):
    """K9: each exchange becomes a user row and an assistant row sharing a session id."""
    return K.exchange_to_turns(_exchanges(spark, root))


def _requests(spark, root):
    """Predict requests: survey rows in API naming, with out-of-range ages mixed in."""
    s = X.survey(spark, root)
    return s.select(
        "person_id",
        F.when(F.col("person_id") % 41 == 0, F.lit(7)).otherwise(F.col("age")).alias("age"),
        "gender", "sleep_duration", "physical_activity", "stress_level",
        F.when(F.col("bmi_category") == "Normal Weight", F.lit("Normal")).otherwise(F.col("bmi_category"))
        .alias("bmi_category"),
        "heart_rate",
        F.split("blood_pressure", "/").getItem(0).try_cast("int").alias("systolic"),
        "sleep_disorder")


REQ_SQL = """
SELECT person_id, CASE WHEN person_id % 41 = 0 THEN 7 ELSE age END AS age, gender, sleep_duration, physical_activity,
       stress_level, CASE WHEN bmi_category = 'Normal Weight' THEN 'Normal' ELSE bmi_category END AS bmi_category,
       heart_rate, TRY_CAST(split_part(blood_pressure, '/', 1) AS INTEGER) AS systolic,
       coalesce(sleep_disorder, 'None') AS sleep_disorder
FROM survey"""


def _range_ok(name):
    lo, hi = C.PREDICT_RANGES[name]
    return f"{name} BETWEEN {lo} AND {hi}"


VALID_SQL = " AND ".join([_range_ok(n) for n in C.PREDICT_RANGES] + [
    f"{n} IN ({', '.join(repr(v) for v in vals)})" for n, vals in C.PREDICT_ENUMS.items()])


REASONS_SQL = ", ".join(
    [x for n in C.PREDICT_RANGES for x in (f"CASE WHEN {n} IS NULL THEN '{n} missing' END",
                                           f"CASE WHEN NOT {_range_ok(n)} THEN '{n} out of range' END")]
    + [f"CASE WHEN {n} IS NULL OR {n} NOT IN ({', '.join(repr(v) for v in vals)}) THEN '{n} not allowed' END"
       for n, vals in C.PREDICT_ENUMS.items()])


@query("c5_valid_requests", with_views(f"SELECT person_id, sleep_disorder FROM req WHERE {VALID_SQL}",
                                       "survey", ctes=f"req AS ({REQ_SQL})"))
def c5_valid_requests(spark, root):
    """Predict requests passing every range and enum check (sleep disorder defaulted)."""
    good, _ = K.split_valid_requests(_requests(spark, root))
    return good.select("person_id", "sleep_disorder")


@query("c5_invalid_requests", with_views(
    f"SELECT person_id, concat_ws('; ', {REASONS_SQL}) AS reasons FROM req WHERE NOT ({VALID_SQL})",
    "survey", ctes=f"req AS ({REQ_SQL})"))
def c5_invalid_requests(spark, root):
    """Rejected requests with their reasons."""
    _, bad = K.split_valid_requests(_requests(spark, root))
    return bad.select("person_id", F.array_join("reasons", "; ").alias("reasons"))


@query("c6_valid_journal", with_views("""
SELECT seq, caffeine_after_17, alcohol, screens_min_before_bed FROM journal
WHERE mood BETWEEN 1 AND 10 AND stress_level BETWEEN 1 AND 10 AND screens_min_before_bed BETWEEN 0 AND 600
""", "journal"))
def c6_valid_journal(spark, root):
    """Journal entries passing the range checks, defaults applied."""
    good, _ = K.split_valid_journal(X.journal(spark, root))
    return good.select("seq", "caffeine_after_17", "alcohol", "screens_min_before_bed")


@query("c6_invalid_journal", with_views("""
SELECT seq, concat_ws('; ', CASE WHEN NOT mood BETWEEN 1 AND 10 THEN 'mood out of range' END,
                           CASE WHEN NOT stress_level BETWEEN 1 AND 10 THEN 'stress_level out of range' END,
                           CASE WHEN NOT screens_min_before_bed BETWEEN 0 AND 600
                                THEN 'screens_min_before_bed out of range' END) AS reasons
FROM journal
WHERE NOT (mood BETWEEN 1 AND 10 AND stress_level BETWEEN 1 AND 10 AND screens_min_before_bed BETWEEN 0 AND 600)
""", "journal"))
def c6_invalid_journal(spark, root):
    """Rejected journal entries with their reasons."""
    _, bad = K.split_valid_journal(X.journal(spark, root))
    return bad.select("seq", F.array_join("reasons", "; ").alias("reasons"))


@query("s5_read_survey", with_views("""
SELECT person_id, gender, age, occupation, sleep_duration, quality_of_sleep, physical_activity, stress_level,
       bmi_category, blood_pressure, heart_rate, physical_activity * 100 AS daily_steps, sleep_disorder
FROM (SELECT *, 'n/a' AS occupation FROM survey) s
""", "survey"))
def s5_read_survey(spark, root):
    """Survey CSV scan (explicit schema, first existing path wins), columns renamed."""
    rows = X.survey(spark, root).withColumns({
        "occupation": F.lit("n/a"), "daily_steps": F.col("physical_activity") * 100})
    path = scratch_path(spark, "survey-csv")
    write_survey_csv(rows, path)
    return read_survey(spark, [path + "-missing", path])


@query("s6_scan_users", with_views("SELECT user_id, email, chronotype, contact_id FROM users", "users"))
def s6_scan_users(spark, root):
    """User table scan with column pruning."""
    return users_of(spark, root).select("user_id", "email", "chronotype", "contact_id")


@query("s6_scan_readings", with_views(
    "SELECT event_id, user_id, event_time, metric, value, unit FROM readings", "readings"))
def s6_scan_readings(spark, root):
    """Reading history scan with column pruning."""
    return readings_of(spark, root).select(
        "event_id", "user_id", "event_time", "metric", "value", "unit")
