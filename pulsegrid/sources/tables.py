"""Batch table scans.

History tables are Parquet: one folder per table, optionally partitioned by
day.  ``read_table`` only names the folder; Catalyst prunes columns and pushes
predicates into the scan, so callers select and filter right after it.
A JDBC source is reachable through ``fmt='jdbc'`` plus options (no driver jar
ships with this image, so that path is untested here).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_utc


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its (Hadoop) file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath))


def table_path(spark: SparkSession, root: str, name: str) -> str:
    """``root/name.parquet`` if it exists on its file system, else ``root/name`` (folder table)."""
    flat = f"{root.rstrip('/')}/{name}.parquet"
    return flat if path_exists(spark, flat) else f"{root.rstrip('/')}/{name}"


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    """Scan a table."""
    ensure_utc(spark)
    reader = spark.read.format(fmt)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if fmt == "jdbc":
        return reader.option("dbtable", name).load()
    return reader.load(table_path(spark, root, name))
