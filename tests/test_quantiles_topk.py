"""Distributed exact percentile (hot group split across tasks) and bounded top-N plans."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pulsegrid.functions.quantiles import percentile_cont, value_slice
from pulsegrid.functions.topk import latest, top_n


def _data(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.choice([None, round(rnd.gauss(70, 12), 2)])) for _ in range(6000)]
    rows += [(f"g{i % 40}", float(rnd.randint(0, 50))) for i in range(800)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 4.0), ("nulls", None)]
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


def test_percentile_matches_builtin(spark):
    df = _data(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for p in (0.5, 0.0, 1.0, 0.25, 0.9):
            ours = {r.k: r.percentile for r in percentile_cont(df, ["k"], "v", p).collect()}
            ref = {r.k: r.ref for r in df.groupBy("k").agg(F.percentile("v", p).alias("ref")).collect()
                   if r.ref is not None}
            assert set(ours) == set(ref)
            for k in ref:
                assert abs(ours[k] - ref[k]) <= 1e-9 * max(1.0, abs(ref[k])), (p, k, ours[k], ref[k])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_group_meets_its_slices_in_many_partitions(spark):
    """The rows of a hot group are joined by (group, slice): no task gets the whole group."""
    df = _data(spark)
    parts = df.where("v IS NOT NULL").repartition(16, F.col("k"), value_slice(F.col("v"))).where("k = 'hot'")
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 0.35 * sum(sizes)


def test_slices_ascend_with_the_value(spark):
    rnd = random.Random(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), 1.0, 2.0, -1.0]
    values += [rnd.gauss(0, 10 ** rnd.randint(-300, 300)) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").withColumn("b", value_slice(F.col("v"))).collect()
    known = sorted((r for r in rows if r.v is not None), key=lambda r: (r.v != r.v, r.v))
    assert all(a.b <= b.b for a, b in zip(known, known[1:]))
    assert [r.b for r in rows if r.v is None] == [None]


def test_percentile_without_a_checkpoint(spark):
    """One aggregation feeds all figures, and nothing runs before the query does."""
    out = percentile_cont(_data(spark), ["k"], "v", 0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RDDScan" not in plan.replace("Scan ExistingRDD", "") and "rangepartitioning" not in plan


def test_top_n_uses_partial_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    out = top_n(df, ["g"], [F.col("x").desc()], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = sorted((r.g, r.x, r.rn) for r in out.collect())
    assert got == [(0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]


def test_latest_picks_greatest_order_tuple(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c"), (2, 1, 1, "d")],
                               "k int, t int, s int, v string")
    got = sorted((r.k, r.t, r.s, r.v) for r in latest(df, ["k"], ["t", "s"], ["v"]).collect())
    assert got == [(1, 5, 2, "b"), (2, 1, 1, "d")]


def test_percentile_is_exact_without_exchange_reuse(spark):
    df = _data(spark)
    ref = {r.k: r.ref for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("ref")).collect()
           if r.ref is not None}
    saved = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled",
                                            "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ours = {r.k: r.percentile for r in percentile_cont(df, ["k"], "v", 0.5).collect()}
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert ours.keys() == ref.keys()
    assert all(abs(ours[k] - ref[k]) <= 1e-9 * max(1.0, abs(ref[k])) for k in ref)


def test_pane_windows_equal_sliding_windows(spark):
    from pulsegrid.operators.aggregates import flatten_window, window_agg
    from pulsegrid.plans.common import readings_of
    from conftest import SF_SMALL
    r = readings_of(spark, SF_SMALL)
    a = flatten_window(window_agg(r))
    b = flatten_window(window_agg(r, panes=True)).select(*a.columns)
    near = [F.round(c, 9).alias(c) if c == "avg_value" else c for c in a.columns]
    a, b = a.select(*near), b.select(*near)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_null_group_keys_keep_their_median(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "k string, v double")
    got = {r.k: r.percentile for r in percentile_cont(df, ["k"], "v", 0.5).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_approximate_median_is_close_to_exact(spark):
    from pulsegrid.operators.aggregates import metric_stats
    from pulsegrid.plans.common import readings_of
    from conftest import SF_SMALL
    r = readings_of(spark, SF_SMALL)
    exact = {(x.user_id, x.metric): x for x in metric_stats(r, "2024-01-31 00:00:00", 720).collect()}
    approx = {(x.user_id, x.metric): x for x in
              metric_stats(r, "2024-01-31 00:00:00", 720, exact_median=False).collect()}
    assert exact.keys() == approx.keys()
    for k, e in exact.items():
        a = approx[k]
        assert (a.n_samples, a.min_value, a.max_value) == (e.n_samples, e.min_value, e.max_value)
        assert abs(a.avg_value - e.avg_value) <= 1e-9 * abs(e.avg_value)
        assert e.min_value <= a.median_value <= e.max_value
