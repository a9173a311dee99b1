"""Registered rendering queries (F1-F3) and sink projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import aggregates as A
from ..operators import render as RD
from ..streaming import sinks as K
from .catalog import query
from .common import AS_OF, alerts_of, dates_as_timestamps, readings_of, users_of
from .oracle_views import with_views
from .q_joins import _context

ICON_SQL = ("CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SEVERITY_ICON.items())
            + f" ELSE '{C.DEFAULT_ICON}' END")
ISO_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%f+00:00')"
PYISO_SQL = ("CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00') "
             "ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f+00:00') END")


def _q(text: str) -> str:
    return text.replace("'", "''")


BASE, PRE, POST = _q(C.PROMPT_BASE), _q(C.PROMPT_PRE_SLEEP), _q(C.PROMPT_POST_SLEEP)


@query("f1_alert_message", with_views(f"""
SELECT event_id, rule_pos,
  {ICON_SQL} || ' *' || coalesce(title, '{C.DEFAULT_ALERT_TITLE}') || '*' || chr(10) || chr(10) || coalesce(text, '')
  || CASE WHEN coalesce(metric, '') <> '' THEN chr(10) || chr(10) || '{C.LABEL_METRIC} `' || metric || '`' ELSE '' END
  || CASE WHEN value IS NOT NULL THEN chr(10) || '{C.LABEL_VALUE} `' || CAST(value AS VARCHAR) || '`' ELSE '' END
  || chr(10) || chr(10) || '— {C.NOTIFICATION_SIGNATURE}' AS message
FROM alerts
""", "alerts"))
def f1_alert_message(spark, root):
    """notification text per alert (icon, title, text, metric and value lines)."""
    a = alerts_of(spark, root)
    return a.select("event_id", "rule_pos", RD.alert_message(a).alias("message"))


def _md_sql() -> str:
    from .. import constants as C
    from .q_joins import ALERT_SCOPE, METRICS_IN, READ_SCOPE

    def lit(text):
        return "'" + _q(text) + "'"

    def cast(expr):
        return f"coalesce(CAST({expr} AS VARCHAR), 'None')"

    def boolean(expr):
        return f"CASE {expr} WHEN true THEN 'True' WHEN false THEN 'False' ELSE 'None' END"

    nl = "chr(10)"
    stat_line = (f"'- **' || metric || '**: n=' || n || ', media=' || {cast('round(avg_v, 1)')} || ', min=' || "
                 f"{cast('round(min_v, 1)')} || ', max=' || {cast('round(max_v, 1)')}")
    phase_line = f"'- ' || stage || ': ' || {cast('pct')} || '% (' || n || ' muestras)'"
    alert_line = f"'- [' || {cast('severity')} || '] ' || {cast('title')} || ': ' || {cast('text')}"
    body = f"""
SELECT ids.user_id, concat_ws({nl},
  {lit(C.MD_HEADER.format(h=720))},
  {lit(C.MD_NOW.format(now='2024-01-31T00:00:00+00:00'))},
  CASE WHEN u.user_id IS NOT NULL THEN {lit('Usuario: ')} || coalesce(u.name, {lit(C.MD_UNKNOWN_NAME)})
       || {lit(' · cronotipo: ')} || coalesce(u.chronotype, {lit(C.MD_UNKNOWN_CHRONOTYPE)}) END,
  '',
  CASE WHEN st.lines IS NOT NULL THEN {lit(C.MD_STATS)} || {nl} || st.lines || {nl} END,
  CASE WHEN ph.lines IS NOT NULL THEN {lit(C.MD_PHASES)} || {nl} || ph.lines || {nl} END,
  CASE WHEN al.lines IS NOT NULL THEN {lit(C.MD_ALERTS)} || {nl} || al.lines || {nl} END,
  CASE WHEN jr.user_id IS NOT NULL THEN concat_ws({nl}, {lit(C.MD_JOURNAL)},
    '- Fecha: ' || strftime(jr.entry_date, '%Y-%m-%d'),
    '- Mood: ' || {cast('jr.mood')} || '/10, estrés: ' || {cast('jr.stress_level')} || '/10',
    '- Cafeína tarde: ' || {boolean('jr.caffeine_after_17')} || ', alcohol: ' || {boolean('jr.alcohol')},
    CASE WHEN jr.screens_min_before_bed IS NOT NULL
         THEN '- Pantallas antes de dormir: ' || jr.screens_min_before_bed || ' min' END,
    CASE WHEN coalesce(jr.notes, '') <> '' THEN '- Notas: ' || jr.notes END) END) AS markdown
FROM ids
LEFT JOIN users u ON ids.user_id = u.user_id
LEFT JOIN st ON ids.user_id = st.user_id
LEFT JOIN ph ON ids.user_id = ph.user_id
LEFT JOIN al ON ids.user_id = al.user_id
LEFT JOIN jr ON ids.user_id = jr.user_id
"""
    ctes = f"""
sm AS (SELECT user_id, metric, count(*) AS n, avg(value) AS avg_v, min(value) AS min_v, max(value) AS max_v
       FROM readings WHERE {READ_SCOPE} AND metric IN ({METRICS_IN}) GROUP BY user_id, metric),
st AS (SELECT user_id, string_agg({stat_line}, {nl} ORDER BY metric) AS lines FROM sm GROUP BY user_id),
pd AS (SELECT user_id, string_split(phase, 'Analysis')[-1] AS stage, count(*) AS n,
              round(100 * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 1) AS pct
       FROM readings WHERE {READ_SCOPE} AND phase IS NOT NULL GROUP BY user_id, phase),
ph AS (SELECT user_id, string_agg({phase_line}, {nl} ORDER BY pct DESC, stage, n) AS lines FROM pd GROUP BY user_id),
ar AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC, rule_pos) AS rn
       FROM alerts WHERE {ALERT_SCOPE}),
al AS (SELECT user_id, string_agg({alert_line}, {nl} ORDER BY rn) AS lines FROM ar WHERE rn <= 10 GROUP BY user_id),
jr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY entry_date DESC, seq DESC) AS rn
       FROM journal) t WHERE rn = 1),
ids AS (SELECT user_id FROM users UNION SELECT user_id FROM st UNION SELECT user_id FROM ph
        UNION SELECT user_id FROM al UNION SELECT user_id FROM jr)"""
    return with_views(body, "readings", "alerts", "users", "journal", ctes=ctes)


@query("f2_context_markdown", _md_sql())
def f2_context_markdown(spark, root):
    """the context snapshot of every user rendered as Markdown."""
    ctx = _context(spark, root)
    return ctx.select("user_id", RD.context_markdown(ctx).alias("markdown"))


def _chat_requests(spark, root):
    """Chat requests: one per user, cycling the presets (one unknown) and the context flag."""
    u = users_of(spark, root)
    preset = (F.when(F.col("user_id") % 4 == 0, "default").when(F.col("user_id") % 4 == 1, "pre_sleep")
              .when(F.col("user_id") % 4 == 2, "post_sleep").otherwise("bedtime"))
    return u.select("user_id", preset.alias("preset"), (F.col("user_id") % 2 == 0).alias("include_context"))


@query("f3_prompt_text", with_views(f"""
SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'pre_sleep' WHEN 2 THEN 'post_sleep'
                                 ELSE 'bedtime' END AS preset,
  CASE user_id % 4 WHEN 1 THEN '{BASE}' || chr(10) || chr(10) || '{PRE}'
                   WHEN 2 THEN '{BASE}' || chr(10) || chr(10) || '{POST}'
                   ELSE '{BASE}' END AS prompt
FROM users
""", "users"))
def f3_prompt_text(spark, root):
    """the system prompt per request preset (unknown preset -> default), without context."""
    r = _chat_requests(spark, root)
    return r.select("user_id", "preset", RD.prompt_text(F.col("preset"), F.lit(False)).alias("prompt"))


def _prompt_ctx_sql() -> str:
    return with_views(f"""
SELECT r.user_id, r.preset,
  CASE WHEN r.include_context AND m.markdown IS NOT NULL THEN r.base || chr(10) || chr(10) || m.markdown
       ELSE r.base END AS prompt
FROM (SELECT user_id, user_id % 2 = 0 AS include_context,
             CASE user_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'pre_sleep' WHEN 2 THEN 'post_sleep'
                              ELSE 'bedtime' END AS preset,
             CASE user_id % 4 WHEN 1 THEN '{BASE}' || chr(10) || chr(10) || '{PRE}'
                              WHEN 2 THEN '{BASE}' || chr(10) || chr(10) || '{POST}'
                              ELSE '{BASE}' END AS base
      FROM users) r
LEFT JOIN ({_md_sql()}) m ON r.user_id = m.user_id
""", "users")


@query("f3_prompt_with_context", _prompt_ctx_sql())
def f3_prompt_with_context(spark, root):
    """prompt plus the user's context Markdown where the request asks for it."""
    r = _chat_requests(spark, root)
    ctx = _context(spark, root)
    md = ctx.select("user_id", RD.context_markdown(ctx).alias("md"))
    j = r.join(md, "user_id", "left")
    return j.select("user_id", "preset", RD.prompt_text(F.col("preset"), F.col("include_context"),
                                                        F.col("md")).alias("prompt"))


# --- sink projections -------------------------------------------------------

@query("k1_raw_docs", with_views(f"""
SELECT 'biometrics-2024-01-31' AS "index", {ISO_SQL.format(c='event_time')} AS "@timestamp", user_id, metric, value,
       unit, phase, coalesce(source_name, 'simulator') AS source, CAST(NULL AS VARCHAR) AS ingested_at
FROM readings
""", "readings"))
def k1_raw_docs(spark, root):
    """K1: raw reading documents for the daily index (write date from a fixed clock)."""
    return K.raw_docs(readings_of(spark, root), now=AS_OF).drop("doc_id")


@query("k2_agg_docs", with_views(f"""
SELECT 'biometrics-agg-2024-01-31' AS "index",
       {PYISO_SQL.format(c='ws')} || '|' || CAST(user_id AS VARCHAR) || '|' || metric AS doc_id,
       {PYISO_SQL.format(c='ws')} AS "@timestamp", {PYISO_SQL.format(c='(ws + INTERVAL 5 MINUTE)')} AS window_end,
       user_id, metric, round(avg(value) + 1e-9, 6) AS avg_value,
       min(value) AS min_value, max(value) AS max_value, count(value) AS n_samples
FROM x GROUP BY ALL
""", "readings", ctes="""
x AS (SELECT date_trunc('minute', event_time) - k * INTERVAL 1 MINUTE AS ws, r.*
      FROM readings r, range(5) g(k))"""))
def k2_agg_docs(spark, root):
    """K2: window-aggregate documents with deterministic ids (window start, user, metric)."""
    docs = K.agg_docs(A.flatten_window(A.window_agg(readings_of(spark, root))), now=AS_OF)
    return docs.withColumn("avg_value", F.round(F.col("avg_value") + 1e-9, 6))


K3_SQL = with_views("""
SELECT event_time AS time, user_id, metric, value, coalesce(source_name, 'simulator') AS source,
       CASE WHEN phase IS NULL THEN '{}' ELSE '{"phase":"' || phase || '"}' END AS metadata,
       lpad(CAST(event_id AS VARCHAR), 20, '0') AS row_id, CAST(CAST(event_time AS DATE) AS TIMESTAMP) AS event_date
FROM readings
""", "readings")


@query("k3_reading_rows", K3_SQL)
def k3_reading_rows(spark, root):
    """K3: reading-history rows with metadata as JSON text."""
    return dates_as_timestamps(K.reading_rows(readings_of(spark, root)))


@query("k4_alert_rows", with_views("""
SELECT user_id, created_at, severity, category, title, text,
       '{"metric":"' || metric || '","value":' || CAST(value AS VARCHAR)
       || CASE WHEN phase IS NULL THEN '' ELSE ',"phase":"' || phase || '"' END || '}' AS metadata,
       lpad(CAST(event_id AS VARCHAR), 20, '0') AS row_id, rule_pos, CAST(CAST(created_at AS DATE) AS TIMESTAMP) AS event_date
FROM alerts
""", "alerts"))
def k4_alert_rows(spark, root):
    """K4: alert-history rows, extra fields packed as JSON (nulls omitted)."""
    return dates_as_timestamps(K.alert_rows(alerts_of(spark, root)))


@query("k5_alert_records", with_views("""
SELECT CAST(user_id AS VARCHAR) AS key, 'alerts.detected' AS topic, severity, title, value, user_id
FROM alerts
""", "alerts"))
def k5_alert_records(spark, root):
    """K5: alert-topic records (key = user id, JSON value), read back field by field."""
    rec = K.alert_records(alerts_of(spark, root))
    return rec.select(
        "key", "topic", F.get_json_object("value", "$.severity").alias("severity"),
        F.get_json_object("value", "$.title").alias("title"),
        F.get_json_object("value", "$.value").cast("double").alias("value"),
        F.get_json_object("value", "$.user_id").cast("bigint").alias("user_id"))


@query("k10_history_layout", K3_SQL)
def k10_history_layout(spark, root):
    """Reading history laid out by day, sorted (user, metric, time desc) within partitions."""
    return dates_as_timestamps(K.layout(K.reading_rows(readings_of(spark, root))))
