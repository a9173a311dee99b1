"""Threshold rules (R1-R9) as Catalyst expressions.

Each rule is a pair of SQL expressions over (metric, value, phase): a cheap
``guard`` (can this reading fire?) and an ``alert`` struct (null = no
alert).  The executor keeps rule order, lets a reading raise 0..n alerts,
and filters on the OR of the guards first, so with a Parquet history the
metric/value predicates reach the scan and row groups are skipped.  No UDF:
the executor is one codegen stage (filter, generate, project).  Rules are
written as SQL text so a plan is built with a handful of calls into the JVM.

Null value or null phase means no alert (D1).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def sql_str(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fill_sql(template: str, **exprs: str) -> str:
    """``concat`` of a fixed template's literal pieces and SQL expressions for ``{name}``."""
    parts, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in exprs if "{" + k + "}" in rest]
        if not hits:
            parts.append(sql_str(rest))
            break
        i, k = min(hits)
        if i:
            parts.append(sql_str(rest[:i]))
        parts.append(exprs[k])
        rest = rest[i + len(k) + 2:]
    return "concat(" + ", ".join(parts) + ")"


def value_text_sql(v: str, places: int) -> str:
    """R8 as SQL: fixed-point text, half-even on the binary value, no grouping."""
    pattern = "0" if places == 0 else "0." + "0" * places
    return f"format_number({v}, '{pattern}')"


def short_stage_sql(p: str) -> str:
    return f"substring_index({p}, '{C.STAGE_SPLIT_TOKEN}', -1)"


def alert_sql(severity: str, category: str, title: str, text: str, phase: str | None = None) -> str:
    """R7 core: the rule-specific part of an alert record (``severity`` is SQL)."""
    return (f"named_struct('severity', {severity}, 'category', {sql_str(category)}, 'title', {sql_str(title)}, "
            f"'text', {text}, 'phase', {phase or 'CAST(NULL AS STRING)'})")


@dataclass(frozen=True)
class Rule:
    name: str
    guard: Callable[[str, str, str], str]
    alert: Callable[[str, str, str], str]


def _hr_asleep_guard(m, v, p):
    return f"{m} = 'heart_rate' AND {v} > {C.HR_SLEEP_MAX}"


def _hr_asleep(m, v, p):
    sev = f"CASE WHEN {v} > {C.HR_SLEEP_CRITICAL} THEN 'critical' ELSE 'warning' END"
    text = fill_sql(C.TEXT_HR_ASLEEP, v=value_text_sql(v, 0), stage=short_stage_sql(p))
    return (f"CASE WHEN {_hr_asleep_guard(m, v, p)} AND contains({p}, 'Asleep') "
            f"THEN {alert_sql(sev, C.CAT_CARDIO, C.TITLE_HR_ASLEEP, text, p)} END")


def _tachy_guard(m, v, p):
    return f"{m} = 'heart_rate' AND {v} > {C.HR_TACHYCARDIA + C.HR_TACHYCARDIA_MARGIN}"


def _tachy(m, v, p):
    text = fill_sql(C.TEXT_TACHY, v=value_text_sql(v, 0))
    return (f"CASE WHEN {_tachy_guard(m, v, p)} AND contains({p}, 'Awake') "
            f"THEN {alert_sql(sql_str('warning'), C.CAT_CARDIO, C.TITLE_TACHY, text)} END")


def _spo2_guard(m, v, p):
    return f"{m} = 'oxygen' AND {v} < {C.SPO2_LOW}"


def _spo2(m, v, p):
    vt = value_text_sql(v, 1)
    crit = alert_sql(sql_str("critical"), C.CAT_RESPIRATORY, C.TITLE_SPO2_CRITICAL,
                     fill_sql(C.TEXT_SPO2_CRITICAL, v=vt))
    warn = alert_sql(sql_str("warning"), C.CAT_RESPIRATORY, C.TITLE_SPO2_LOW, fill_sql(C.TEXT_SPO2_LOW, v=vt))
    return (f"CASE WHEN {m} = 'oxygen' AND {v} < {C.SPO2_HYPOXIA} THEN {crit} "
            f"WHEN {_spo2_guard(m, v, p)} THEN {warn} END")


def _hrv_guard(m, v, p):
    return f"{m} = 'hrv' AND {v} < {C.HRV_VERY_LOW}"


def _hrv(m, v, p):
    body = alert_sql(sql_str("warning"), C.CAT_RECOVERY, C.TITLE_HRV_LOW,
                     fill_sql(C.TEXT_HRV_LOW, v=value_text_sql(v, 0)))
    return f"CASE WHEN {_hrv_guard(m, v, p)} THEN {body} END"


def _temp_guard(m, v, p):
    return f"{m} = 'temperature' AND ({v} > {C.TEMP_HIGH_FEVER} OR {v} < {C.TEMP_LOW_HYPOTHERMIA})"


def _temp(m, v, p):
    vt = value_text_sql(v, 1)
    fever = alert_sql(sql_str("critical"), C.CAT_GENERAL, C.TITLE_FEVER, fill_sql(C.TEXT_FEVER, v=vt))
    low = alert_sql(sql_str("warning"), C.CAT_GENERAL, C.TITLE_TEMP_LOW, fill_sql(C.TEXT_TEMP_LOW, v=vt))
    return (f"CASE WHEN {m} = 'temperature' AND {v} > {C.TEMP_HIGH_FEVER} THEN {fever} "
            f"WHEN {m} = 'temperature' AND {v} < {C.TEMP_LOW_HYPOTHERMIA} THEN {low} END")


ALL_RULES = [
    Rule("hr_asleep", _hr_asleep_guard, _hr_asleep),      # R1: HR > 90 asleep; critical > 110
    Rule("tachycardia", _tachy_guard, _tachy),           # R2: HR > 120 awake
    Rule("spo2", _spo2_guard, _spo2),                    # R3: SpO2 < 90 critical, < 92 warning
    Rule("hrv", _hrv_guard, _hrv),                       # R4: HRV < 20
    Rule("temperature", _temp_guard, _temp),             # R5: > 38.0 critical, < 35.5 warning
]
RULES_BY_NAME = {r.name: r for r in ALL_RULES}

ALERT_COLUMNS = ["user_id", "created_at", "severity", "category", "title", "text",
                 "metric", "value", "phase"]


def phase_sql(df: DataFrame) -> str:
    return "try_element_at(metadata, 'phase')" if "metadata" in df.columns else "phase"


def detect_alerts(df: DataFrame, rules: list[Rule] | None = None, created_at=None,
                  keep: list[str] | None = None) -> DataFrame:
    """Every rule on every reading, rule order kept, 0..n alerts per reading.

    ``created_at`` is a column (default: the current timestamp, as the stream
    job stamps alerts); pass the event time or a fixed clock for replays.
    Output: the alert record (R7) plus ``rule``, ``rule_pos`` and ``keep``.
    """
    rules = list(rules or ALL_RULES)
    m, v, p = "metric", "value", phase_sql(df)
    created = F.current_timestamp() if created_at is None else (
        F.lit(created_at).cast("timestamp") if isinstance(created_at, str) else created_at)
    guard = " OR ".join(f"({r.guard(m, v, p)})" for r in rules)
    tagged = ", ".join(f"named_struct('rule', '{r.name}', 'a', {r.alert(m, v, p)})" for r in rules)
    keep = [c for c in (keep or []) if c not in ALERT_COLUMNS]
    fired = (df.where(guard).withColumn("_created_at", created)
             .selectExpr("user_id", "metric", "value", *keep, "_created_at AS created_at",
                         f"posexplode(array({tagged})) AS (rule_pos, r)")
             .where("r.a IS NOT NULL"))
    return fired.selectExpr(
        "user_id", "created_at", "r.a.severity AS severity", "r.a.category AS category", "r.a.title AS title",
        "r.a.text AS text", "metric", "value", "r.a.phase AS phase", "r.rule AS rule", "rule_pos", *keep)


def single_rule(df: DataFrame, name: str, created_at=None, keep: list[str] | None = None) -> DataFrame:
    """R1-R5 one at a time (same executor, one rule)."""
    return detect_alerts(df, [RULES_BY_NAME[name]], created_at=created_at, keep=keep)


def hr_watch(df: DataFrame, width: str = C.HR_WATCH_WINDOW, limit: float = C.HR_WATCH_LIMIT,
             time_col: str = "event_time") -> DataFrame:
    """R9 (own definition): tumbling 1-minute heart-rate avg/max per user, flagged above ``limit``.

    Map-side partial aggregation; on a stream it runs under the watermark.
    """
    hr = df.where(F.col("metric") == "heart_rate")
    agg = hr.groupBy(F.window(time_col, width).alias("window"), "user_id").agg(
        F.avg("value").alias("avg_hr"), F.max("value").alias("max_hr"), F.count("value").alias("n_samples"))
    return agg.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "user_id", "avg_hr", "max_hr", "n_samples", (F.col("avg_hr") > limit).alias("flagged"))
