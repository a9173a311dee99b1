"""Text rendering as columns (F1-F3): notification text, context Markdown, prompt text.

Everything is ``concat``/``concat_ws``/``transform`` over the row, so
rendering runs inside the executors next to the data; no service call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import bool_text, fill
from .ingest import iso_text


def _icon(severity: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for kv in C.SEVERITY_ICON.items() for x in kv])
    return F.coalesce(F.try_element_at(icons, severity), F.lit(C.DEFAULT_ICON))


def alert_message(alerts: DataFrame, signature: str = C.NOTIFICATION_SIGNATURE) -> Column:
    """chat notification text of an alert row; empty metric / null value lines are left out."""
    title = F.coalesce(F.col("title"), F.lit(C.DEFAULT_ALERT_TITLE))
    text = F.coalesce(F.col("text"), F.lit(""))
    metric_line = F.when(F.coalesce(F.col("metric"), F.lit("")) != "",
                         F.concat(F.lit(f"\n\n{C.LABEL_METRIC} `"), F.col("metric"), F.lit("`")))
    value_line = F.when(F.col("value").isNotNull(),
                        F.concat(F.lit(f"\n{C.LABEL_VALUE} `"), F.col("value").cast("string"), F.lit("`")))
    return F.concat(_icon(F.col("severity")), F.lit(" *"), title, F.lit("*\n\n"), text,
                    F.coalesce(metric_line, F.lit("")), F.coalesce(value_line, F.lit("")),
                    F.lit(f"\n\n— {signature}"))


def _num(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def context_markdown(ctx: DataFrame) -> Column:
    """the context snapshot (J3 row) as Markdown; empty sections are skipped.

    Metrics are listed by name and stages by percent descending (T5); the
    list-valued sections are ``transform``s over the row's bounded arrays.
    """
    now_text = iso_text(F.col("now"))
    header = fill(C.MD_HEADER, h=F.col("window_hours").cast("string"))
    now_line = fill(C.MD_NOW, now=now_text)
    user_line = F.when(F.col("user").isNotNull(), fill(
        C.MD_USER, name=F.coalesce(F.col("user.name"), F.lit(C.MD_UNKNOWN_NAME)),
        chronotype=F.coalesce(F.col("user.chronotype"), F.lit(C.MD_UNKNOWN_CHRONOTYPE))))
    stats = F.array_sort(F.map_entries("biometrics"))
    stat_lines = F.transform(stats, lambda e: fill(
        C.MD_STAT_LINE, metric=e["key"], n=_num(e["value"]["n_samples"]), avg=_num(e["value"]["avg"]),
        min=_num(e["value"]["min"]), max=_num(e["value"]["max"])))
    stats_block = F.when(F.size("biometrics") > 0, F.concat(
        F.array(F.lit(C.MD_STATS)), stat_lines, F.array(F.lit(""))))
    phases = F.array_sort(
        F.transform(F.map_entries("sleep_phases"), lambda e: F.struct(
            (-e["value"]["pct"]).alias("k"), e["key"].alias("stage"), e["value"]["n"].alias("n"),
            e["value"]["pct"].alias("pct"))))
    phase_lines = F.transform(phases, lambda p: fill(
        C.MD_PHASE_LINE, stage=p["stage"], pct=_num(p["pct"]), n=_num(p["n"])))
    phase_block = F.when(F.size("sleep_phases") > 0, F.concat(
        F.array(F.lit(C.MD_PHASES)), phase_lines, F.array(F.lit(""))))
    alert_lines = F.transform("recent_alerts", lambda a: fill(
        C.MD_ALERT_LINE, severity=F.coalesce(a["severity"], F.lit("None")),
        title=F.coalesce(a["title"], F.lit("None")), text=F.coalesce(a["text"], F.lit("None"))))
    alert_block = F.when(F.size("recent_alerts") > 0, F.concat(
        F.array(F.lit(C.MD_ALERTS)), alert_lines, F.array(F.lit(""))))
    j = F.col("journal")
    journal_block = F.when(j.isNotNull(), F.array(
        F.lit(C.MD_JOURNAL),
        fill(C.MD_J_DATE, date=F.date_format(j["entry_date"], "yyyy-MM-dd")),
        fill(C.MD_J_MOOD, mood=_num(j["mood"]), stress=_num(j["stress_level"])),
        fill(C.MD_J_HABITS, caffeine=bool_text(j["caffeine_after_17"]), alcohol=bool_text(j["alcohol"])),
        F.when(j["screens_min_before_bed"].isNotNull(),
               fill(C.MD_J_SCREENS, screens=j["screens_min_before_bed"].cast("string"))),
        F.when(F.coalesce(j["notes"], F.lit("")) != "", fill(C.MD_J_NOTES, notes=j["notes"]))))
    return F.concat_ws("\n", header, now_line, user_line, F.lit(""), stats_block, phase_block, alert_block,
                       journal_block)


def base_prompt(preset: Column) -> Column:
    """prompt for a preset; unknown presets fall back to the default."""
    return (F.when(preset == "pre_sleep", F.lit(C.PROMPT_BASE + "\n\n" + C.PROMPT_PRE_SLEEP))
            .when(preset == "post_sleep", F.lit(C.PROMPT_BASE + "\n\n" + C.PROMPT_POST_SLEEP))
            .otherwise(F.lit(C.PROMPT_BASE)))


def prompt_text(preset: Column, include_context: Column, context_md: Column | None = None) -> Column:
    """preset prompt plus, when asked for and available, the context Markdown."""
    base = base_prompt(preset)
    if context_md is None:
        return base
    return F.when(include_context & context_md.isNotNull(),
                  F.concat(base, F.lit("\n\n"), context_md)).otherwise(base)
