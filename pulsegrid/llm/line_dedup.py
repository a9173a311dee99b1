"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending id.  A *run* is a written table of
line hashes and nothing else, bucketed and sorted by the hash; runs never
share a hash.  Each batch is joined with the runs: a hash that a run holds
belongs to an earlier document, so the batch loses those lines; the hashes that
no run holds (merge-anti-join) become a new run of level 0.  Whenever a level
has ``FANOUT`` runs they are merged into one run of the next level, so there
are at most ``FANOUT`` runs a level and a hash is rewritten once a level.

All runs have the same buckets, so a join shuffles the batch's distinct hashes
only, never a run; compaction shuffles the runs it merges.
A line that stands in a third of all documents is one row of a batch's distinct
hashes (pre-aggregated per task); its occurrences meet the decision about it in
a join of two written tables, which AQE splits.

Hashes have 128 bits (XXH3).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialize, small_batches, text_or_empty

BATCHES = 4
FANOUT = 2
MIN_CHARS = 10
_WS = " \t\n\v\f\r"
_LAST = (1 << 63) - 1


def line_hash(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line's key (stripped, A-Z lower-cased); None for keys that are too short to count."""
    key = line.strip(_WS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


class LevelledRuns:
    """Sorted runs of 128-bit hashes, by level; each is a bucketed table in the shared folder."""

    def __init__(self, buckets: int, fanout: int = FANOUT) -> None:
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def held(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` with ``held``: whether some run has the hash."""
        out = hashes.withColumn("held", F.lit(False))
        for run in (run for level in self.levels for run in level):
            out = (out.join(run.withColumn("here", F.lit(True)), ["hi", "lo"], "left")
                   .withColumn("held", F.col("held") | F.col("here").isNotNull()).drop("here"))
        return out

    def _write(self, hashes: DataFrame) -> DataFrame:
        return bucketed(hashes.select("hi", "lo"), "run", self.buckets, "hi", "lo")

    def add(self, hashes: DataFrame) -> None:
        """A new run of distinct hashes that no run holds; compacts each level that is full."""
        self.levels[0].append(self._write(hashes))
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = self._write(reduce(DataFrame.unionByName, level))
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct (row, line hash): ord, th (the text's hash), hi, lo."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, counts, digests = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), [], []
            for text in batch.column(2):
                own = {h for line in text.as_py().split("\n") if (h := line_hash(line, min_chars))}
                counts.append(len(own))
                digests += own
            pair = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.repeat(marks, counts)), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                                             names=["ord", "th", "hi", "lo"])

    return docs.select("ord", "th", "text").mapInArrow(run, "ord bigint, th bigint, hi bigint, lo bigint")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
               batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop lines that an earlier document has: ``id_col``, the columns in ``keep``, n_lines, n_dropped, kept_text.

    A line's key is the line without white space at both ends and with A-Z
    lower-cased.  Keys of at least ``min_chars`` code points keep all their
    lines in the smallest id that has them and lose them everywhere else;
    other lines stay.  A null or empty text is one empty line.  Ids are
    integers; rows that share an id are one document (each row is reported),
    and rows without an id are one document after all others.
    """
    keep = [c for c in keep or [] if c not in (id_col, text_col)]
    spark = docs.sparkSession
    small_batches(docs)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("bigint").alias("ord"), text_or_empty(text_col).alias("text"),
                       F.struct(F.col(id_col), *keep).alias("row")).withColumn("th", F.xxhash64("text"))
    occurrences = materialize(_occurrences(rows, min_chars), "line-hashes")

    cuts = occurrences.agg(F.percentile_approx("ord", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    runs, drops = LevelledRuns(buckets, fanout), []
    for low, high in zip(bounds, bounds[1:]):
        batch = occurrences
        if low is not None:
            batch = batch.where(F.col("ord") > low)
        if high is not None:
            batch = batch.where(F.col("ord") <= high)
        hashes = batch.groupBy("hi", "lo").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
        known = materialize(runs.held(hashes), "batch-hashes")
        runs.add(known.where(~F.col("held")))
        decided = known.where(F.col("held") | (F.col("first") < F.col("last")))
        drops.append(batch.join(decided, ["hi", "lo"]).where(F.col("held") | (F.col("ord") > F.col("first"))).select("ord", "th", "hi", "lo"))
    gone = materialize(reduce(DataFrame.unionByName, drops), "dropped-lines")
    # a row's lines, not an id's: a third of all rows may lack an id (texts of one id and hash share their lines' decisions anyway)
    by_row = gone.groupBy("ord", "th").agg(F.collect_set(F.struct("hi", "lo")).alias("out")).select(
        "ord", "th", F.transform("out", lambda x: x["hi"]).alias("his"), F.transform("out", lambda x: x["lo"]).alias("los"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept_text = [], [], []
            for text, his, los in zip(batch.column("text"), batch.column("his"), batch.column("los")):
                text = text.as_py()
                lines = text.split("\n")
                n_lines.append(len(lines))
                if his.is_valid:
                    pair = np.stack([his.values.to_numpy(), los.values.to_numpy()], axis=1).astype("<i8").tobytes()
                    out = {pair[i:i + 16] for i in range(0, len(pair), 16)}
                    stay = [x for x in lines if line_hash(x, min_chars) not in out]
                    n_dropped.append(len(lines) - len(stay))
                    kept_text.append("\n".join(stay))
                else:
                    n_dropped.append(0)
                    kept_text.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                              pa.array(kept_text, pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])

    out = rows.join(by_row, ["ord", "th"], "left").select("row", "text", "his", "los")
    kind = rows.schema["row"].dataType.simpleString()
    out = out.mapInArrow(rebuild, f"row {kind}, n_lines bigint, n_dropped bigint, kept_text string")
    return out.select("row.*", "n_lines", "n_dropped", "kept_text")
