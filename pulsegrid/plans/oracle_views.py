"""DuckDB twins of ``pulsegrid.sources.fixtures`` (adapter views), as CTE bodies.

``with_views(sql, 'readings', 'alerts')`` prefixes an oracle query with the
needed CTEs (dependencies included).  The base tables are the driver's
pre-registered views.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS: dict[str, str] = {}
DEPENDS: dict[str, list[str]] = {}

VIEWS["readings"] = """
SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS event_time,
  CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'view' THEN 'hrv' WHEN 'error' THEN 'oxygen'
                  WHEN 'purchase' THEN 'temperature' ELSE 'respiration' END AS metric,
  CASE event_type WHEN 'click' THEN 50 + value / 2 WHEN 'view' THEN 10 + value WHEN 'error' THEN 100 - value / 10
                  WHEN 'purchase' THEN 35 + value / 40 ELSE 10 + value / 10 END AS value,
  CASE event_type WHEN 'view' THEN 'ms' WHEN 'error' THEN '%' WHEN 'purchase' THEN 'degC' ELSE 'count/min' END AS unit,
  CASE WHEN k >= 95 THEN NULL ELSE concat('HKCategoryValueSleepAnalysis',
       CASE k % 5 WHEN 0 THEN 'Awake' WHEN 1 THEN 'InBed' WHEN 2 THEN 'AsleepCore' WHEN 3 THEN 'AsleepDeep'
                  ELSE 'AsleepREM' END) END AS phase,
  CASE WHEN k >= 95 THEN NULL ELSE 'watch-sim' END AS source_name
FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e
"""

VIEWS["users"] = """
SELECT c_custkey AS user_id, concat(lower(c_name), '@example.org') AS email, c_name AS name,
  CASE c_nationkey % 3 WHEN 0 THEN 'morning' WHEN 1 THEN 'evening' ELSE 'intermediate' END AS chronotype,
  'Europe/Madrid' AS timezone,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('chat-', CAST(c_custkey AS VARCHAR)) END AS contact_id
FROM customer
"""

VIEWS["contact_links"] = """
SELECT o_orderkey AS seq, o_custkey + o_orderkey % 3 AS user_id, concat('new-', CAST(o_orderkey AS VARCHAR)) AS contact_id
FROM orders
"""

VIEWS["journal"] = """
SELECT o_orderkey AS seq, o_custkey AS user_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS entry_date,
  CASE WHEN o_orderkey % 53 = 0 THEN 11 ELSE CAST(1 + o_orderkey % 10 AS INTEGER) END AS mood,
  CAST(1 + o_custkey % 10 AS INTEGER) AS stress_level,
  o_orderstatus = 'F' AS caffeine_after_17, o_orderstatus = 'O' AS alcohol,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 700 AS INTEGER) AS screens_min_before_bed,
  o_orderpriority AS notes, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders
"""

VIEWS["chat_turns"] = """
SELECT conv_id, turn, conv_id % 15 AS user_id, role, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 600 + turn) * INTERVAL '1' SECOND AS created_at
FROM conversations
"""

VIEWS["survey"] = """
SELECT s.*, CAST(greatest(1, least(10, 10 - floor(stress_level / 2) + floor(sleep_duration - 6))) AS INTEGER)
         AS quality_of_sleep
FROM (SELECT c_custkey AS person_id, CASE c_custkey % 2 WHEN 0 THEN 'Male' ELSE 'Female' END AS gender,
  CAST(18 + c_custkey % 60 AS INTEGER) AS age, 5 + (c_custkey % 36) / CAST(10 AS DOUBLE) AS sleep_duration,
  CAST(30 + c_custkey % 61 AS INTEGER) AS physical_activity, CAST(1 + c_nationkey % 10 AS INTEGER) AS stress_level,
  CASE c_custkey % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Normal Weight' WHEN 2 THEN 'Overweight' ELSE 'Obese' END
       AS bmi_category,
  concat(CAST(110 + c_custkey % 40 AS VARCHAR), '/', CAST(70 + c_custkey % 25 AS VARCHAR)) AS blood_pressure,
  CAST(60 + c_nationkey AS INTEGER) AS heart_rate,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Insomnia' ELSE 'Sleep Apnea' END AS sleep_disorder
  FROM customer) s
"""

# Alerts: the eight rule branches, in rule order (rule_pos = rule index).
_ALERT_BRANCH = """
SELECT user_id, event_time AS created_at, {sev} AS severity, '{cat}' AS category, '{title}' AS title,
  {text} AS text, metric, value, {phase} AS phase, '{rule}' AS rule, {pos} AS rule_pos, event_id, event_time
FROM readings WHERE {cond}
"""


def _q(s: str) -> str:
    return s.replace("'", "''")


def _alerts_sql() -> str:
    from .. import constants as C

    def txt(template: str, places: int, stage: bool = False) -> str:
        t = "'" + _q(template).replace("{v}", f"' || printf('%.{places}f', value) || '")
        if stage:
            t = t.replace("{stage}", "' || string_split(phase, 'Analysis')[-1] || '")
        return t + "'"

    branches = [
        dict(rule="hr_asleep", pos=0, cat=C.CAT_CARDIO, title=C.TITLE_HR_ASLEEP,
             sev="CASE WHEN value > 110 THEN 'critical' ELSE 'warning' END",
             text=txt(C.TEXT_HR_ASLEEP, 0, True), phase="phase",
             cond="metric = 'heart_rate' AND contains(phase, 'Asleep') AND value > 90"),
        dict(rule="tachycardia", pos=1, cat=C.CAT_CARDIO, title=C.TITLE_TACHY, sev="'warning'",
             text=txt(C.TEXT_TACHY, 0), phase="CAST(NULL AS VARCHAR)",
             cond="metric = 'heart_rate' AND contains(phase, 'Awake') AND value > 120"),
        dict(rule="spo2", pos=2, cat=C.CAT_RESPIRATORY, title=C.TITLE_SPO2_CRITICAL, sev="'critical'",
             text=txt(C.TEXT_SPO2_CRITICAL, 1), phase="CAST(NULL AS VARCHAR)",
             cond="metric = 'oxygen' AND value < 90"),
        dict(rule="spo2", pos=2, cat=C.CAT_RESPIRATORY, title=C.TITLE_SPO2_LOW, sev="'warning'",
             text=txt(C.TEXT_SPO2_LOW, 1), phase="CAST(NULL AS VARCHAR)",
             cond="metric = 'oxygen' AND value >= 90 AND value < 92"),
        dict(rule="hrv", pos=3, cat=C.CAT_RECOVERY, title=C.TITLE_HRV_LOW, sev="'warning'",
             text=txt(C.TEXT_HRV_LOW, 0), phase="CAST(NULL AS VARCHAR)",
             cond="metric = 'hrv' AND value < 20"),
        dict(rule="temperature", pos=4, cat=C.CAT_GENERAL, title=C.TITLE_FEVER, sev="'critical'",
             text=txt(C.TEXT_FEVER, 1), phase="CAST(NULL AS VARCHAR)",
             cond="metric = 'temperature' AND value > 38.0"),
        dict(rule="temperature", pos=4, cat=C.CAT_GENERAL, title=C.TITLE_TEMP_LOW, sev="'warning'",
             text=txt(C.TEXT_TEMP_LOW, 1), phase="CAST(NULL AS VARCHAR)",
             cond="metric = 'temperature' AND value < 35.5"),
    ]
    return " UNION ALL ".join(
        _ALERT_BRANCH.format(**{**b, "title": _q(b["title"])}) for b in branches)


VIEWS["alerts"] = _alerts_sql()
DEPENDS["alerts"] = ["readings"]


def with_views(sql: str, *names: str, ctes: str = "") -> str:
    """Prefix ``sql`` with the CTEs of ``names`` (and dependencies), then ``ctes``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    if ctes.strip():
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + sql
