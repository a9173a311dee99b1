"""Aggregations over readings and alerts.

All are declarative ``groupBy``/``window`` aggregates, so Spark plans a
partial (map-side) aggregate, one shuffle on the grouping keys and a final
aggregate; skewed keys are pre-combined before the shuffle.  The same
functions run on streaming frames (A1, A6, A9 with a watermark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.metrics import has_key, phase_of, short_stage, strip_stage_prefix
from ..functions.quantiles import pick_percentile, sliced_stats


def _ts(value) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def since(df: DataFrame, as_of, hours: float | None, time_col: str = "event_time",
          date_col: str = "event_date") -> DataFrame:
    """Rows in ``[as_of - hours, as_of]``; ``hours=None`` keeps everything up to ``as_of``.

    On a day-partitioned history (``date_col`` present) the same range is
    also stated on the day column, so Spark prunes whole partitions.
    """
    if as_of is None:
        return df
    end = _ts(as_of)
    start = end - F.make_dt_interval(secs=F.lit(int(hours * 3600))) if hours is not None else None
    cond = F.col(time_col) <= end
    if start is not None:
        cond = cond & (F.col(time_col) >= start)
    if date_col in df.columns:
        cond = cond & (F.col(date_col) <= F.to_date(end))
        if start is not None:
            cond = cond & (F.col(date_col) >= F.to_date(start))
    return df.where(cond)


# --- A1 / A2: sliding window aggregate (flagship) -------------------------

def window_agg(df: DataFrame, width: str = C.AGG_WINDOW, slide: str = C.AGG_SLIDE,
               time_col: str = "event_time", panes: bool = False) -> DataFrame:
    """A1: sliding window per user and metric: avg, min, max, count(value).

    Default: Spark's sliding ``window`` (each row expanded to width/slide
    windows, then partially aggregated); the same code runs on streams.
    ``panes=True`` (batch only): aggregate each row once into slide-sized
    panes, then combine width/slide panes per window, which costs about one
    aggregation update per raw row instead of width/slide when readings are
    dense; results are the same up to the order of the additions.
    """
    if panes and not df.isStreaming:
        return _window_agg_panes(df, width, slide, time_col)
    return df.groupBy(F.window(time_col, width, slide).alias("window"), "user_id", "metric").agg(
        F.avg("value").alias("avg_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.count("value").alias("n_samples"))


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _window_agg_panes(df: DataFrame, width: str, slide: str, time_col: str) -> DataFrame:
    w, sl = _seconds(width), _seconds(slide)
    if w % sl:
        raise ValueError("pane aggregation needs the width to be a multiple of the slide")
    pane = F.window(time_col, slide).start
    panes = df.where(F.col(time_col).isNotNull()).groupBy("user_id", "metric", pane.alias("_p")).agg(
        F.sum("value").alias("_s"), F.count("value").alias("_n"),
        F.min("value").alias("_min"), F.max("value").alias("_max"))
    start = F.col("_p") - F.make_dt_interval(secs=F.col("_k") * sl)
    spread = panes.select("*", F.explode(F.sequence(F.lit(0), F.lit(w // sl - 1))).alias("_k")).withColumn(
        "window", F.struct(start.alias("start"), (start + F.make_dt_interval(secs=F.lit(w))).alias("end")))
    agg = spread.groupBy("window", "user_id", "metric").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("n_samples"), F.min("_min").alias("min_value"),
        F.max("_max").alias("max_value"))
    return agg.select("window", "user_id", "metric",
                      F.try_divide("_s", "n_samples").alias("avg_value"),
                      "min_value", "max_value", "n_samples")


def flatten_window(df: DataFrame, window_col: str = "window") -> DataFrame:
    """A2: window struct -> ``window_start`` / ``window_end`` (UTC)."""
    rest = [c for c in df.columns if c != window_col]
    return df.select(F.col(f"{window_col}.start").alias("window_start"),
                     F.col(f"{window_col}.end").alias("window_end"), *rest)


# --- A3 / A4 / A5: context statistics -------------------------------------

def metric_stats(df: DataFrame, as_of=None, hours: float | None = 6,
                 metrics: list[str] = C.CONTEXT_METRICS, time_col: str = "event_time",
                 exact_median: bool = True, accuracy: int = 10000) -> DataFrame:
    """A3: per user and metric in the last ``hours``: count(*), avg, min, max, exact median.

    The rows are counted per (user, metric, value slice) in one aggregation;
    all figures but the median come from those counts, and the median reads
    only the rows of the slice it lies in (see ``functions.quantiles``).

    ``exact_median=False`` instead computes ``percentile_approx`` in the same
    single aggregation (a bounded sketch per group, rank error about
    n / ``accuracy``): one pass, for dashboards that accept it.
    """
    scoped = since(df, as_of, hours, time_col).where(F.col("metric").isin(metrics))
    keys = ["user_id", "metric"]
    if not exact_median:
        return scoped.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_samples"), F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"), F.max("value").alias("max_value"),
            F.percentile_approx("value", 0.5, accuracy).alias("median_value"))
    stats = pick_percentile(scoped, sliced_stats(scoped, keys, "value"), keys, "value", 0.5, "median_value")
    return stats.select(*keys, F.col("n_rows").alias("n_samples"), F.col("avg").alias("avg_value"),
                        F.col("min").alias("min_value"), F.col("max").alias("max_value"), "median_value")


def phase_distribution(df: DataFrame, as_of=None, hours: float | None = 6,
                       time_col: str = "event_time") -> DataFrame:
    """A4: per user, readings having a phase key: count and percent of the user's total (1 place).

    The percent uses a window over the already aggregated rows (at most one
    row per stage per user), so no raw group is gathered.
    """
    counts = phase_totals(df, as_of, hours, time_col)
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return counts.select("user_id", short_stage(F.col("phase")).alias("stage"), "phase", "n",
                         F.round(100 * F.col("n") / total, 1).alias("pct"))


def phase_totals(df: DataFrame, as_of=None, hours: float | None = 6, time_col: str = "event_time") -> DataFrame:
    """Readings per user and full phase name in the window (rows having a phase key)."""
    scoped = since(df, as_of, hours, time_col)
    if "metadata" in df.columns:
        scoped = scoped.where(has_key("metadata", "phase"))
    else:
        scoped = scoped.where(F.col("phase").isNotNull())
    return scoped.groupBy("user_id", phase_of(scoped).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


def phase_counts(df: DataFrame) -> DataFrame:
    """A5: readings per stage name with the prefix removed (anchored), per user."""
    if "metadata" in df.columns:
        df = df.where(has_key("metadata", "phase"))
    return df.groupBy("user_id", strip_stage_prefix(phase_of(df)).alias("stage")).agg(
        F.count(F.lit(1)).cast("int").alias("n"))


# --- A6-A8: trends --------------------------------------------------------

def bucket_avg(df: DataFrame, metric: str, width: str = "1 hour", time_col: str = "event_time",
               start_time: str | None = None) -> DataFrame:
    """Tumbling-bucket average of one metric per user (no gap filling)."""
    win = F.window(time_col, width, startTime=start_time) if start_time else F.window(time_col, width)
    agg = df.where(F.col("metric") == metric).groupBy("user_id", win.alias("w")).agg(
        F.avg("value").alias("avg_value"))
    return agg.select("user_id", F.col("w.start").alias("bucket"), "avg_value")


def bucket_summary(buckets: DataFrame) -> DataFrame:
    """Legend figures over the bucket averages: mean, min, max per user."""
    return buckets.groupBy("user_id").agg(
        F.avg("avg_value").alias("mean_of_buckets"), F.min("avg_value").alias("min_of_buckets"),
        F.max("avg_value").alias("max_of_buckets"), F.count(F.lit(1)).alias("n_buckets"))


# --- A9-A14: alert dashboards ---------------------------------------------

def alerts_per_minute(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    """Alerts per user and minute, optionally for one severity."""
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity)
    return alerts.groupBy("user_id", F.date_trunc("minute", "created_at").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"))


def alert_timeline(alerts: DataFrame, wide: bool = False) -> DataFrame:
    """Alerts per user, minute and severity; ``wide`` pivots the three fixed severities."""
    keyed = alerts.groupBy("user_id", F.date_trunc("minute", "created_at").alias("minute"))
    if wide:
        return keyed.pivot("severity", C.SEVERITIES).agg(F.count(F.lit(1))).fillna(0, C.SEVERITIES)
    return alerts.groupBy("user_id", F.date_trunc("minute", "created_at").alias("minute"), "severity").agg(
        F.count(F.lit(1)).alias("n"))


def alert_totals(alerts: DataFrame) -> DataFrame:
    """Panel totals per user in one pass: all, critical, warning, info."""
    return alerts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES])


def alerts_by_category(alerts: DataFrame) -> DataFrame:
    """Alerts per user and category (order by ``n`` desc when presenting)."""
    return alerts.groupBy("user_id", "category").agg(F.count(F.lit(1)).cast("int").alias("n"))


def alert_count(alerts: DataFrame) -> DataFrame:
    """Global alert count."""
    return alerts.agg(F.count(F.lit(1)).alias("n_alerts"))


def readings_by_metric(df: DataFrame) -> DataFrame:
    """Readings per metric."""
    return df.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


def dispatch_stats(alerts: DataFrame, routed: DataFrame) -> DataFrame:
    """Delivery counters: alerts received, and of those with a user how many go to each channel.

    ``alerts`` is the alert frame before routing: an alert without a user is
    received, but goes nowhere.  ``routed`` is J1's left join: the live channel
    takes every routed alert, the chat channel those with a contact id.
    """
    received = alerts.agg(F.count(F.lit(1)).alias("received"))
    sent = routed.agg(F.count(F.lit(1)).alias("live"), F.count("contact_id").alias("chat"))
    stacked = received.select("received", F.lit(0).alias("live"), F.lit(0).alias("chat")).unionByName(
        sent.select(F.lit(0).alias("received"), "live", "chat"))
    return stacked.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("received", "live", "chat")])
