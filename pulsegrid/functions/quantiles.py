"""Exact continuous percentiles without holding a group in one task.

``percentile_cont`` / ``median`` build one buffer per group in the final
aggregation task, so one hot group (say, a user with a third of all readings)
lands in a single task.  Here:

1. rows are counted per (group, value slice); a slice is a fixed interval of
   the number line (``SLICES`` per power of two), in the order of the values.
   The partial aggregation makes this small before anything is shuffled;
2. a group's slices are put in order and the one or two slices that hold the
   target ranks are found.  A slice whose smallest and largest value are equal
   gives its value at once;
3. otherwise the rows of those slices (and only they) are counted per value
   and the value of the rank is picked.  The join is on (group, slice), so a
   hot group's rows arrive in as many partitions as it has slices.

Results equal ``percentile_cont(p)`` (linear interpolation between the ranks
floor/ceil of p*(n-1), 0-based).  Null values are ignored, as there; NaN is
the largest value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 256          # per power of two: a slice is at most 0.4 % of its values wide
_ORIGIN = 1100 * SLICES   # above the logarithm of any double
_SLICE = "struct<b:bigint,c:bigint,lo:double,hi:double>"


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with null-safe equality (a null group key is a group, as in GROUP BY)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_slice(value: Column) -> Column:
    """The number of the value's slice: ascending with the value; null for null."""
    v = value.cast("double")
    size = F.abs(v)
    place = F.floor(F.log2(size) * SLICES) + _ORIGIN
    place = F.when(size == 0, 0).when(size == float("inf"), 2 * _ORIGIN).otherwise(place)
    return F.when(F.isnan(v), F.lit(4 * _ORIGIN)).when(v.isNotNull(), F.when(v < 0, -place).otherwise(place)).cast("bigint")


def slice_parts(df: DataFrame, keys: list[str], value: str, at: str | None = None) -> DataFrame:
    """Per group and value slice ``_b`` (or the column ``at`` that holds it): rows, values, sum, min, max.  Parts of parts add up."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys, at or value_slice(v).alias("_b")).agg(
        F.count(F.lit(1)).alias("_all"), F.count(v).alias("_c"), F.sum(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))


def stats_of_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: n_rows, n, avg, min, max and ``_slices``: its value slices in order with count, min and max (one part a slice)."""
    piece = F.when(F.col("_c") > 0, F.struct(F.col("_b").alias("b"), F.col("_c").alias("c"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))
    return parts.groupBy(*keys).agg(
        F.sum("_all").alias("n_rows"), F.sum("_c").alias("n"), F.try_divide(F.sum("_s"), F.sum("_c")).alias("avg"),
        F.min("_lo").alias("min"), F.max("_hi").alias("max"), F.array_sort(F.collect_list(piece)).alias("_slices"))


def sliced_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``stats_of_parts`` of the rows' own parts."""
    return stats_of_parts(slice_parts(df, keys, value), keys)


def _located(rank: Column) -> Column:
    """The slice that holds the 0-based rank, and the rank within it (``k``)."""
    start = F.struct(F.lit(0).cast("bigint").alias("off"), F.lit(None).cast(_SLICE).alias("at"), F.lit(None).cast("bigint").alias("k"))
    found = F.aggregate(F.col("_slices"), start, lambda a, x: F.when(a["at"].isNotNull() | (a["off"] + x["c"] <= rank), F.struct(
        (a["off"] + x["c"]).alias("off"), a["at"].alias("at"), a["k"].alias("k"))).otherwise(F.struct(
            (a["off"] + x["c"]).alias("off"), x.alias("at"), (rank - a["off"]).cast("bigint").alias("k"))))
    return F.struct(found["at"]["b"].alias("b"), found["at"]["lo"].alias("lo"), found["at"]["hi"].alias("hi"), found["k"].alias("k"))


def pick_percentile(df: DataFrame, stats: DataFrame, keys: list[str], value: str, p: float = 0.5,
                    alias: str = "percentile", kept: Callable[[DataFrame], DataFrame] = lambda spots: spots) -> DataFrame:
    """``stats`` (from ``sliced_stats`` of the same rows) with the exact percentile of ``value``; null for groups without values.

    The located ranks, a row a group, are read twice; ``kept`` may store them, so that the slices are counted once.
    """
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be in [0, 1]")
    pos = F.lit(p) * (F.col("n") - 1)
    spots = stats.withColumn("_frac", pos - F.floor(pos)).withColumns(
        {"_at_lo": F.when(F.col("n") > 0, _located(F.floor(pos))), "_at_hi": F.when(F.col("n") > 0, _located(F.ceil(pos)))}).drop("_slices")
    spots = kept(spots)
    wanted = spots.select(*keys, F.explode(F.array_distinct(F.array("_at_lo", "_at_hi"))).alias("x")).where(F.col("x.lo") != F.col("x.hi"))
    wanted = wanted.groupBy(*keys, F.col("x.b").alias("_b")).agg(F.array_sort(F.collect_set("x.k")).alias("_ks"))  # one or two ranks

    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", value_slice(F.col("_v"))).where(F.col("_b").isNotNull())
    counts = join_on(rows, wanted, [*keys, "_b"]).groupBy(*keys, "_b", "_ks", "_v").agg(F.count(F.lit(1)).alias("_c"))
    lists = counts.groupBy(*keys, "_b", "_ks").agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_vs"))

    def at(k: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("off"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("_vs", start, lambda a, x: F.struct(
            (a["off"] + x["_c"]).alias("off"), F.when((a["off"] <= k) & (k < a["off"] + x["_c"]), x["_v"]).otherwise(a["v"]).alias("v")))["v"]

    picked = lists.select(*keys, F.explode(F.transform("_ks", lambda k: F.struct(F.col("_b").alias("b"), k.alias("k"), at(k).alias("v")))).alias("y"))
    picked = picked.groupBy(*keys).agg(F.collect_list("y").alias("_picked"))  # two entries at most
    out = join_on(spots, picked, keys, "left")

    def value_of(spot: str) -> Column:
        s = F.col(spot)
        same = F.filter("_picked", lambda y: (y["b"] == s["b"]) & (y["k"] == s["k"]))
        return F.when(s["lo"].eqNullSafe(s["hi"]), s["lo"]).otherwise(F.try_element_at(same, F.lit(1))["v"])

    lo, hi, d = value_of("_at_lo"), value_of("_at_hi"), F.col("_frac")
    # lo * (1 - d) + hi * d: the weighting Spark's own percentile and SQL engines use (same last bits)
    exact = F.when(d == 0, lo).otherwise(lo * (1 - d) + hi * d)
    return out.withColumn(alias, exact).drop("_at_lo", "_at_hi", "_frac", "_picked")


def percentile_cont(df: DataFrame, keys: list[str], value: str, p: float = 0.5, alias: str = "percentile") -> DataFrame:
    """Exact ``percentile_cont(p)`` of ``value`` per group of ``keys`` that has values."""
    out = pick_percentile(df, sliced_stats(df, keys, value), keys, value, p, alias)
    return out.where("n > 0").select(*keys, alias)
