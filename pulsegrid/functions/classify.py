"""Classification columns: dashboard bands (C4), sleep-quality category and score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band_of(value_col, bands: list[tuple[float | None, str]]) -> Column:
    """Label of the highest band whose lower bound (inclusive) is <= value; null value -> null."""
    v = _col(value_col)
    expr = None
    for lower, label in reversed(bands):
        cond = v.isNotNull() if lower is None else v >= lower
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def band(value_col, metric_col) -> Column:
    """C4: band per reading from the metric's band table (null for metrics without one)."""
    m = _col(metric_col)
    expr = None
    for metric, bands in C.BANDS.items():
        if metric == "alert_total":
            continue
        b = band_of(value_col, bands)
        expr = F.when(m == metric, b) if expr is None else expr.when(m == metric, b)
    return expr


def quality_category(raw_col) -> Column:
    """Category of the raw (unrounded) predicted quality."""
    q = _col(raw_col)
    return (F.when(q <= C.QUALITY_POOR_MAX, C.QUALITY_POOR)
            .when(q <= C.QUALITY_GOOD_MAX, C.QUALITY_GOOD)
            .when(q.isNotNull(), C.QUALITY_EXCELLENT))


def quality_score(raw_col) -> Column:
    """Clamp to [1, 10], times 10, one decimal."""
    q = _col(raw_col).cast("double")
    return F.round(F.greatest(F.lit(C.SCORE_MIN), F.least(F.lit(C.SCORE_MAX), q)) * 10, 1)
