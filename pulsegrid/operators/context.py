"""User context snapshot (J3): one nested row per user.

Four per-user frames (metric stats, stage distribution, newest alerts,
latest journal entry) are reduced by aggregations whose groups are bounded
(<= 5 metrics, <= 6 stages, <= N alerts after the partial top-N), then
stacked with the user rows and combined by one ``groupBy(user_id)``.
Nothing per user grows with the raw history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import short_stage
from ..operators.aggregates import metric_stats, phase_totals
from ..operators.history import latest_journal, recent_alerts


def user_context(users: DataFrame, readings: DataFrame, alerts: DataFrame, journal: DataFrame,
                 as_of, hours: float = 6, n_alerts: int = 10) -> DataFrame:
    """Nested snapshot per user: user, biometrics map, sleep-phase map, alert list, journal.

    The parts are stacked (``unionByName``) as tagged rows and combined by a
    single ``groupBy(user_id)``; each user gathers at most 5 + 6 + n_alerts + 2
    small rows, so the combine is one bounded shuffle instead of a chain of joins.
    Stage percentages are computed in that combine from the user's stage
    counts (no separate window pass).
    """
    stats = metric_stats(readings, as_of, hours).select("user_id", F.struct(
        F.col("metric").alias("k"), F.struct(
            F.col("n_samples"), F.round("avg_value", 1).alias("avg"), F.round("min_value", 1).alias("min"),
            F.round("max_value", 1).alias("max"), F.round("median_value", 1).alias("median")).alias("v"))
        .alias("_stat"))
    # by short stage: two full names of one stage are one entry, and a null phase is none
    phases = phase_totals(readings, as_of, hours).where(F.col("phase").isNotNull()).groupBy(
        "user_id", short_stage(F.col("phase")).alias("stage")).agg(F.sum("n").alias("n"))
    phases = phases.select("user_id", F.struct("stage", "n").alias("_phase"))
    recent = recent_alerts(alerts, n_alerts, as_of, hours).select("user_id", F.struct(
        "rn", "created_at", "severity", "category", "title", "text").alias("_alert"))
    jr = latest_journal(journal).select("user_id", F.struct(
        "entry_date", "mood", "stress_level", "caffeine_after_17", "alcohol", "screens_min_before_bed",
        "notes").alias("_journal"))
    people = users.select("user_id", F.struct("name", "chronotype", "timezone").alias("_user"))
    stacked = (people.unionByName(stats, allowMissingColumns=True)
               .unionByName(phases, allowMissingColumns=True)
               .unionByName(recent, allowMissingColumns=True)
               .unionByName(jr, allowMissingColumns=True))
    as_of_col = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    combined = stacked.groupBy("user_id").agg(
        F.first("_user", ignorenulls=True).alias("user"),
        F.map_from_entries(F.collect_list("_stat")).alias("biometrics"),
        _phase_map(F.collect_list("_phase")).alias("sleep_phases"),
        F.transform(F.array_sort(F.collect_list("_alert")), lambda a: a.dropFields("rn")).alias("recent_alerts"),
        F.first("_journal", ignorenulls=True).alias("journal"))
    return combined.select("user_id", F.lit(int(hours)).alias("window_hours"), as_of_col.alias("now"), "user",
                           "biometrics", "sleep_phases", "recent_alerts", "journal")


def _phase_map(entries):
    """A4 inside the per-user combine: stage -> (n, percent of the user's phase readings, 1 place)."""
    total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(
        x["stage"].alias("k"), F.struct(x["n"].alias("n"), F.round(100 * x["n"] / total, 1).alias("pct")).alias("v"))))


def flatten_context(ctx: DataFrame) -> DataFrame:
    """The scalar parts of the snapshot (for checking against SQL)."""
    return ctx.select(
        "user_id", F.col("user.name").alias("name"), F.col("user.chronotype").alias("chronotype"),
        F.size("biometrics").alias("n_metrics"),
        F.coalesce(F.try_element_at("biometrics", F.lit("heart_rate"))["n_samples"], F.lit(0)).alias("hr_n"),
        F.size("sleep_phases").alias("n_stages"),
        F.size("recent_alerts").alias("n_alerts"),
        F.try_element_at("recent_alerts", F.lit(1))["title"].alias("newest_alert_title"),
        F.col("journal.entry_date").alias("journal_date"), F.col("journal.mood").alias("journal_mood"))
