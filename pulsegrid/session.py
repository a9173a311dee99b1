"""Session construction and session-level contracts.

partitions and "now minus N hours" are all computed in the session zone, so
every entry point pins it.  Lineage cuts and streaming checkpoints go to the
shared folder named by ``spark.checkpoint.dir``; without that setting a private
folder is made in local mode (tests) and any other master is refused.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # window state (user x metric x window) outside the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    app_name: str = "pulsegrid",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master`` and ``shuffle_partitions`` are left to the cluster unless
    given; on a cluster AQE sizes shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Pin the session zone to UTC (all time logic assumes it)."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever folder the driver was started in.

    Nothing to do where the workers' path has it (``PYTHONPATH``,
    ``--py-files``).  Workers on the driver's machine get this folder on their
    path; on a cluster the package goes along as a zip, once a session.
    """
    import pulsegrid

    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(pulsegrid.__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ".zip" in root or root in map(os.path.abspath, filter(None, paths)) or getattr(sc, "_pulsegrid_shipped", False):
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, sc.environment.get("PYTHONPATH", "")]))  # workers beside the driver
    if not sc.master.startswith("local[") and sc.master != "local":
        folder = tempfile.mkdtemp(prefix="pulsegrid-", dir=sc._temp_dir)  # served to executors from here, gone with the session
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "pulsegrid"), "zip", root, "pulsegrid"))
    sc._pulsegrid_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, stream checkpoints and scratch tables.

    Read from the session (``spark.checkpoint.dir``).  When it is unset, a local
    session gets a private folder, registered so later calls agree; on a
    cluster, where a machine's own folder would lose data, it is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            return current.rstrip("/")
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pulsegrid-ckpt-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder of scratch tables under the checkpoint root."""
    return os.path.join(checkpoint_root(spark), "pulsegrid", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the application's scratch folder for a written table."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_DROPPED = [0]


def scratch_generation() -> int:
    """Changes whenever scratch tables were dropped: what was remembered of them is void."""
    return _DROPPED[0]


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables (when no frame that reads them is needed any more)."""
    _DROPPED[0] += 1
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
