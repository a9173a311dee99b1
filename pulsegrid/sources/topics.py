"""S1 / S4 from topic logs in files: a broker's contract (topics by pattern, partitions, offsets) without a broker.

Records lie in ``topic=<name>/partition=<n>/segment=<first>-<last>``, a folder of Parquet a segment, written by
``append_segments`` and never changed.  ``TopicLogs`` is a Spark data source over them.  A stream's offset is
a number per topic and partition, kept in its checkpoint: a restart goes on where it stopped, a start can name
any offset, a topic that appears later is read from its beginning, and segments that retention removed before
they were read are skipped (``failOnDataLoss`` = true makes that an error).

Tasks read segments, several of a partition at once; order within a partition is told by ``offset``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "pulsegrid_topics"
SCHEMA = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
_SEGMENT = re.compile(r"topic=([^/]+)/partition=(\d+)/segment=(\d+)-(\d+)/?$")

Offsets = dict[str, dict[str, int]]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def segments(path: str) -> dict[tuple[str, int], list[tuple[int, int, str]]]:
    """(topic, partition) -> (first, last, folder) of its segments, ascending.  Folders are listed, nothing is read."""
    from pyarrow import fs

    system, root = _file_system(path)
    out: dict[tuple[str, int], list] = {}

    def walk(folder: str, depth: int) -> None:
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type != fs.FileType.Directory:
                continue
            found = _SEGMENT.search(info.path)
            if depth == 2 and found:
                out.setdefault((found[1], int(found[2])), []).append((int(found[3]), int(found[4]), info.path))
            elif depth < 2 and not info.base_name.startswith((".", "_")):
                walk(info.path, depth + 1)

    walk(root, 0)
    return {key: sorted(found) for key, found in sorted(out.items())}


class Segment(InputPartition):
    def __init__(self, topic: str, partition: int, folder: str, first: int, end: int) -> None:
        self.topic, self.partition, self.folder, self.first, self.end = topic, partition, folder, first, end


class _Logs:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]) -> None:
        own = {name.lower(): value for name, value in options.items()}
        self.path = own["path"]
        self.wanted = re.compile(own["subscribepattern"] if "subscribepattern" in own else "|".join(map(re.escape, own["subscribe"].split(","))))
        self.start = own.get("startingoffsets", "latest")
        self.strict = own.get("failondataloss", "false").lower() == "true"

    def found(self) -> dict[tuple[str, int], list[tuple[int, int, str]]]:
        return {key: s for key, s in segments(self.path).items() if self.wanted.fullmatch(key[0])}

    def ends(self) -> Offsets:
        out: Offsets = {}
        for (topic, partition), own in self.found().items():
            out.setdefault(topic, {})[str(partition)] = own[-1][1] + 1
        return out

    def between(self, start: Offsets, end: Offsets) -> list[Segment]:
        out = []
        for (topic, partition), own in self.found().items():
            upto = end.get(topic, {}).get(str(partition))
            if upto is None:
                continue
            since = start.get(topic, {}).get(str(partition), 0)  # a topic or partition that is new: from its beginning
            if own[0][0] > since and self.strict and since < upto:
                raise ValueError(f"{topic}/{partition}: offsets {since} to {own[0][0] - 1} are gone")
            out += [Segment(topic, partition, folder, max(first, since), min(last + 1, upto)) for first, last, folder in own if last >= since and first < upto]
        return out

    def rows(self, at: Segment | None) -> Iterator[Any]:
        """Arrow batches of a segment's records between the offsets (Spark reads None where there is no segment)."""
        if at is None:
            return
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        system, folder = _file_system(at.folder)
        within = (pc.field("offset") >= at.first) & (pc.field("offset") < at.end)
        for batch in ds.dataset(folder, filesystem=system, format="parquet").to_batches(columns=["key", "value", "offset", "timestamp"], filter=within):
            n, stamps = batch.num_rows, batch.column("timestamp")
            stamps = stamps if pa.types.is_timestamp(stamps.type) and stamps.type.tz else pc.assume_timezone(stamps, "UTC")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("value"), pa.array([at.topic] * n, pa.string()), pa.array([at.partition] * n, pa.int32()),
                 batch.column("offset"), pc.floor_temporal(stamps, unit="microsecond").cast(pa.timestamp("us", "UTC"))],
                names=["key", "value", "topic", "partition", "offset", "timestamp"])


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.logs = _Logs(options)

    def initialOffset(self) -> dict:
        if self.logs.start == "latest":
            return {"at": json.dumps(self.logs.ends())}
        return {"at": "{}" if self.logs.start == "earliest" else self.logs.start}

    def latestOffset(self) -> dict:
        return {"at": json.dumps(self.logs.ends())}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.logs.between(json.loads(start["at"]), json.loads(end["at"]))

    def read(self, partition: Segment) -> Iterator[Any]:
        return self.logs.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.logs = _Logs(options)

    def partitions(self) -> list[Segment]:
        start = self.logs.start
        return self.logs.between({} if start in ("earliest", "latest") else json.loads(start), self.logs.ends())

    def read(self, partition: Segment) -> Iterator[Any]:
        return self.logs.rows(partition)


class TopicLogs(DataSource):
    """Options: path; subscribePattern or subscribe (names with commas); startingOffsets ('latest', 'earliest', or
    '{"topic": {"0": offset}}'; a batch reads from the beginning unless offsets are given); failOnDataLoss."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLogs)


def append_segments(records: DataFrame, path: str, partitions: int = 4) -> None:
    """Add records (key, value, topic, timestamp) to the logs: one segment a topic and partition, offsets going on.

    A key stays in its partition, in the order of ``timestamp``.  One writer a
    log at a time; a segment appears whole when the job commits.
    """
    spark = records.sparkSession
    ends = [(topic, partition, own[-1][1] + 1) for (topic, partition), own in segments(path).items()]
    base = spark.createDataFrame(ends, "topic string, partition int, next bigint")
    rows = records.select("key", "value", "topic", "timestamp", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"))
    own = Window.partitionBy("topic", "partition")
    rows = rows.join(base, ["topic", "partition"], "left").withColumn(
        "offset", F.coalesce("next", F.lit(0)) + F.row_number().over(own.orderBy("timestamp", "key", "value")) - 1)
    named = F.concat_ws("-", F.lpad(F.min("offset").over(own).cast("string"), 20, "0"), F.lpad(F.max("offset").over(own).cast("string"), 20, "0"))
    (rows.withColumn("segment", named).select("key", "value", "offset", "timestamp", "topic", "partition", "segment").write
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("topic", "partition", "segment").parquet(path))
