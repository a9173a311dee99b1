"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_utc, scratch_path

# The white space of every text contract here: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 16 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder (any path Spark's readers can open)."""
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, so a worker's memory does not grow with the length of texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int((conf.get(key, None) or "0").rstrip("b")) not in range(1, BATCH_BYTES + 1):
        conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder (in folders by ``partition_by``) and read it back.

    Cuts the lineage, fixes generated ids, survives lost executors, and gives
    later joins exchanges on both sides, which AQE can split when skewed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, *by: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder in buckets by ``by`` (sorted) and read it back.

    Later joins and groupings by these columns shuffle nothing of it.  The
    table is external and leaves the catalog at once; the frame keeps its buckets.
    """
    spark = df.sparkSession
    table = f"llm_{uuid.uuid4().hex}"
    (df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by)
     .option("path", scratch_path(spark, f"llm-{name}")).saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def first_by_hash(df: DataFrame, n: int, seed: int, *by: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest seeded hash of the columns ``by`` (ties by those columns).

    Rows whose hash is far above what ``n`` of all rows need are dropped in the
    tasks that read them, so the task that puts the rest in order gets about
    ``2 * n`` rows, not ``n`` from each task.
    """
    total = df.count()
    keyed = df.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 1))
    out = keyed.orderBy("_hash", *by).limit(n).drop("_hash")
    if total <= 4 * n:
        return out
    near = keyed.where(F.col("_hash") < int((1 << 63) / total * 2 * n))
    if near.limit(n).count() < n:  # the hashes of repeated rows can leave too few below the mark
        return out
    return near.orderBy("_hash", *by).limit(n).drop("_hash")


def load_order(df: DataFrame, keys: list, order: list) -> DataFrame:
    """``df`` range-sorted by ``keys`` then ``order`` (columns), with ``_at``: the task's number in its upper bits, the place in the task below.

    A row's own place is the last sort key, so rows alike in all others are
    dealt over tasks too.  ``df`` should be a written table (it is read twice).
    """
    marked = df.withColumn("_row", F.monotonically_increasing_id())
    by = [*keys, *order, F.col("_row")]
    return marked.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id())


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` (a written table) with ``rank``: its rows' places, from 0, in the order of ``order``; no task holds them all."""
    placed = materialize(load_order(df, [], order), name)
    part = F.shiftright("_at", 33)
    tasks = placed.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    tasks = tasks.select("_part", (before - F.col("_first")).alias("_offset"))
    out = placed.join(tasks, part == F.col("_part"))
    return out.withColumn("rank", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_first(col: str = "doc_id") -> Column:
    """Sort key that puts null ids last."""
    return F.struct(F.col(col).isNull().alias("n"), F.col(col).alias("v"))
