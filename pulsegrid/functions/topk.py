"""Top-N per group and latest-per-key, in forms that stay bounded under skew.

``top_n`` is ``row_number() <= n``: Spark rewrites it with a partial
``WindowGroupLimit`` before the shuffle, so each map task sends at most ``n``
rows per group; a hot group's rows are ranked in salted parts before they meet
in one task.  ``latest`` is a ``max`` over a struct led by the ordering
columns: a plain aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_n(df: DataFrame, partition_by: list[str], order_by: list[Column], n: int,
          rank_col: str = "rn") -> DataFrame:
    """Rows ranked 1..n per group by ``order_by`` (give a total order for stable output).

    Two levels: each group is ranked in ``SALTS`` parts first and the parts'
    first ``n`` are ranked together, so the task that gets a hot group reads at
    most ``n * SALTS`` rows, however many map tasks there are.
    """
    parts = Window.partitionBy(*partition_by, "_salt").orderBy(*order_by)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]), F.lit(SALTS)))
    first = salted.withColumn(rank_col, F.row_number().over(parts)).where(F.col(rank_col) <= n).drop("_salt", rank_col)
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    return first.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def latest(df: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """One row per key: the values of the row with the greatest ``order_cols`` tuple."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                      *[F.col(c) for c in value_cols if c not in order_cols])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("_latest"))
    out = [F.col(f"_latest._o{i}").alias(c) for i, c in enumerate(order_cols)]
    out += [F.col(f"_latest.{c}").alias(c) for c in value_cols if c not in order_cols]
    return agg.select(*keys, *out)
