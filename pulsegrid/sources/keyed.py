"""Keyed tables with many small writes (K2, K7-K9, K11): sorted runs in levels, merged as they pile up.

A write adds a run of its rows, sorted by key, at level 0.  When a level holds ``FANOUT`` runs they are
folded into one run of the next level, so a table of n writes has at most FANOUT - 1 runs on each of about
log(n) levels, and a row is rewritten once a level.  Reading folds what the runs say of a key; a read of one
key opens the files whose key range holds it (a few a run), with a Bloom filter in each.

``fold`` gives one row a key and may be applied to parts first and to their results again.  Writes of
streams carry (writer, number); a number that the table already has of that writer is a replay and adds
nothing.  The versions are ``sources.versions``'s: a crash leaves the version that was there.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.topk import latest
from ..operators.keyed import JOURNAL_VALUES, upsert_journal
from ..session import ensure_utc
from . import versions as V

FANOUT = 8
ALL = "-"


class Keyed(NamedTuple):
    """``key``: sort order of a run; its first column is the one point reads look up.  ``fold``: rows -> one row a key."""
    key: tuple[str, ...]
    fold: Callable[[DataFrame], DataFrame]


def _journal(rows: DataFrame) -> DataFrame:
    return upsert_journal(rows, rows.limit(0)).select("seq", "user_id", "entry_date", *JOURNAL_VALUES, "created_at")


def _latest_by(keys: list[str], order: str) -> Callable[[DataFrame], DataFrame]:
    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys and c != order]
        return latest(rows, keys, [order], rest).select(*rows.columns)
    return fold


JOURNAL = Keyed(("user_id", "entry_date"), _journal)                              # K7
CONTACT_LINKS = Keyed(("user_id",), _latest_by(["user_id"], "seq"))               # K8
CHAT = Keyed(("user_id", "created_at"), lambda rows: rows.dropDuplicates(["row_id"]))   # K9
AGG_DOCS = Keyed(("doc_id",), _latest_by(["doc_id"], "batch_id"))                 # K2, D5
PREDICTIONS = Keyed(("user_id", "predicted_at"), lambda rows: rows.dropDuplicates(["user_id", "predicted_at", "model_version", "inputs"]))  # K11


def _run(rows: DataFrame, path: str, table: Keyed) -> list[dict]:
    options = {f"parquet.bloom.filter.enabled#{table.key[0]}": "true"}
    spread = rows.repartitionByRange(*table.key)
    return list(V.write_run(spread, path, order=list(table.key), zones=(table.key[0],), options=options).values())


def _commit(spark: SparkSession, path: str, schema, change: Callable[[list[dict], dict], tuple[list[dict], dict] | None]) -> int:
    """Apply ``change`` (runs, notes -> runs, notes; None: nothing to do) to the newest version until it is the one that commits."""
    while True:
        base = V.state(spark, path)
        part = V.part_of(spark, path, base, ALL)
        after = change(part["runs"], base["notes"])
        if after is None:
            return base["number"]
        number = V.commit(spark, path, base, {ALL: {"runs": after[0], "notes": {}}}, schema, after[1])
        if number is not None:
            return number


def append(df: DataFrame, path: str, table: Keyed, writer: str, number: int, fanout: int = FANOUT) -> int:
    """Add rows as write ``number`` of ``writer`` (numbers ascend); the table's version afterwards."""
    spark = df.sparkSession
    ensure_utc(spark)
    if V.state(spark, path)["notes"].get("writers", {}).get(writer, -1) >= number:
        return V.state(spark, path)["number"]
    rows = table.fold(df)
    made = _run(rows, path, table)

    def change(runs: list[dict], notes: dict) -> tuple[list[dict], dict] | None:
        writers = notes.get("writers", {})
        if writers.get(writer, -1) >= number:
            return None  # another attempt of this write was first
        return runs + [r | {"level": 0} for r in made], {"writers": writers | {writer: number}}

    _commit(spark, path, rows.schema, change)
    return merge_levels(spark, path, table, fanout)


def merge_levels(spark: SparkSession, path: str, table: Keyed, fanout: int = FANOUT) -> int:
    """Fold the runs of every level that has ``fanout`` or more into a run of the next; the version afterwards."""
    while True:
        base = V.state(spark, path)
        runs = V.part_of(spark, path, base, ALL)["runs"]
        level = next((n for n in sorted({r["level"] for r in runs}) if sum(r["level"] == n for r in runs) >= fanout), None)
        if level is None:
            return base["number"]
        own = [r for r in runs if r["level"] == level]
        schema = V.StructType.fromJson(base["schema"])
        rows = table.fold(spark.read.schema(schema).parquet(*V.files_of(path, ALL, own)))
        made, gone = _run(rows, path, table), {r["run"] for r in own}

        def change(now: list[dict], notes: dict, made=made, gone=gone, level=level, own=own) -> tuple[list[dict], dict] | None:
            if not gone <= {r["run"] for r in now}:
                return None  # another merge was first
            return [r for r in now if r["run"] not in gone] + [V.merged_run(m, own) | {"level": level + 1} for m in made], {}

        _commit(spark, path, schema, change)


def read(spark: SparkSession, path: str, table: Keyed, value: Any = None) -> DataFrame:
    """One row a key at the newest version; with ``value`` only those whose first key column equals it."""
    ensure_utc(spark)
    at = V.state(spark, path)
    kind = next(f.dataType for f in V.StructType.fromJson(at["schema"]).fields if f.name == table.key[0]) if at["schema"] else None

    def hit(zones: dict) -> bool:
        lo, hi = zones[table.key[0]]
        if value is None or lo is None:
            return value is None
        own = (str, lo, hi, str(value)) if kind.typeName() == "string" else (float, float(lo), float(hi), float(value))
        return own[1] <= own[3] <= own[2]

    rows = V.read(spark, path, at, keep=hit)
    if value is not None:
        rows = rows.where(F.col(table.key[0]) == F.lit(value))
    runs = V.part_of(spark, path, at, ALL)["runs"]
    return rows if len(runs) == 1 else table.fold(rows)  # a single run is folded already


def absorb(spark: SparkSession, landing: str, path: str, table: Keyed, schema: str, fmt: str = "json", fanout: int = FANOUT) -> int:
    """Bring a stream's landed batches (``writer_id=*/batch_id=*``) that the table lacks into it, as one write; its version afterwards."""
    ensure_utc(spark)
    present = {p.partition("writer_id=")[2].replace("/batch_id=", "/"): p for p, _ in V.glob_paths(spark, f"{landing}/writer_id=*/batch_id=*")}
    known = set(V.state(spark, path)["notes"].get("merged", []))
    new = sorted(set(present) - known)
    if not new:
        return V.state(spark, path)["number"]
    landed = spark.read.schema(schema).option("basePath", landing).format(fmt).load([present[b] for b in new])
    rows = table.fold(landed.withColumn("batch_id", F.col("batch_id").cast("bigint")).drop("writer_id"))
    made = _run(rows, path, table)

    def change(runs: list[dict], notes: dict) -> tuple[list[dict], dict] | None:
        merged = set(notes.get("merged", []))
        if merged & set(new):
            return None  # another absorb was first; what it left comes with the next call
        return runs + [r | {"level": 0} for r in made], {"merged": sorted(merged & set(present) | set(new))}

    _commit(spark, path, rows.schema, change)
    return merge_levels(spark, path, table, fanout)


def retire(spark: SparkSession, landing: str, path: str, min_age_seconds: float = 24 * 3600) -> int:
    """Remove landed batches that the table holds and that are ``min_age_seconds`` old; their number."""
    merged, removed = set(V.state(spark, path)["notes"].get("merged", [])), 0
    for p, age in V.glob_paths(spark, f"{landing}/writer_id=*/batch_id=*"):
        if p.partition("writer_id=")[2].replace("/batch_id=", "/") in merged and age >= min_age_seconds:
            V.delete(spark, p)
            removed += 1
    return removed
