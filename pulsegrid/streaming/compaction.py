"""The day-partitioned history as a versioned table, fed from the streams' landing folders.

Streams land readings (K3) and alerts (K4) in ``event_date=<day>/writer_id=<stream>/batch_id=<n>``.
``compact`` takes the batches that the history does not have yet and commits a new version:

* rows whose id the day already has are left out (a record delivered twice, a replayed batch);
* a day gets a sorted run of its new rows; what left the landing folder long ago stays in the history;
* days without new batches are not read, neither in the landing folder nor in the history;
* a day that has reached ``max_runs`` is then rewritten as one run, in a version of its own that says so:
  the rollups know that it brings nothing new.

``retire`` removes landing batches that a version holds.  A crash at any point leaves the version that
was there; running again does the work anew.

    python -m pulsegrid.streaming.compaction --landing out/readings --table history/readings --retire
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_utc
from ..sources import versions as V
from .sinks import ranged

DAY = "event_date"
MAX_RUNS = 4
# The filter takes the smallest of these sizes (1 MB, halved again and again) that a file's users need; without it each file has 1 MB.
BLOOM = {"parquet.bloom.filter.enabled#user_id": "true", "parquet.bloom.filter.adaptive.enabled": "true",
         "parquet.bloom.filter.candidates.number#user_id": "12"}
_BATCH = re.compile(rf"{DAY}=([^/]+)/writer_id=([^/]+)/batch_id=(\d+)/?$")


def landing_batches(spark: SparkSession, landing: str, days: list[str] | None = None) -> dict[str, dict[str, tuple[str, float]]]:
    """Per day: batch name ('writer/number') -> (path, age in seconds).  Folders are listed, no file is opened."""
    out: dict[str, dict] = {}
    for day in days or [n.partition("=")[2] for n in V.list_names(spark, landing) if n.startswith(f"{DAY}=")]:
        for path, age in V.glob_paths(spark, f"{landing}/{DAY}={day}/writer_id=*/batch_id=*"):
            found = _BATCH.search(path)
            if found:
                out.setdefault(day, {})[f"{found[2]}/{found[3]}"] = (path, age)
    return out


def _keys(rows: DataFrame) -> list[str]:
    return [DAY, "row_id"] + [c for c in ("rule_pos",) if c in rows.columns]


def cluster_columns(rows: DataFrame) -> list[str]:
    """What the rows of a day are sorted by, before the time."""
    return ["user_id", "metric" if "metric" in rows.columns else "severity"]


def time_column(rows: DataFrame) -> str:
    return "time" if "time" in rows.columns else "created_at"


def zone_columns(rows: DataFrame) -> tuple[str, str]:
    return "user_id", time_column(rows)


def compact(spark: SparkSession, landing: str, table: str, days: list[str] | None = None, max_runs: int = MAX_RUNS) -> int:
    """Merge new landing batches (of some days) into the history; its version afterwards.

    Another compaction may run meanwhile: the one that commits second starts
    again from the other's version.
    """
    ensure_utc(spark)
    while True:
        base = V.state(spark, table)
        present = landing_batches(spark, landing, days)
        held = {day: V.part_of(spark, table, base, day) for day in present}
        new = {day: [p for b, (p, _) in batches.items() if b not in held[day]["notes"].get("merged", [])] for day, batches in present.items()}
        new = {day: paths for day, paths in new.items() if paths}
        if not new:
            return base["number"]
        landed = spark.read.option("basePath", landing).parquet(*[p for paths in new.values() for p in paths])
        landed = landed.drop("writer_id", "batch_id").withColumn(DAY, F.col(DAY).cast("date"))
        keys = _keys(landed)
        rows = _once(landed, keys)
        known = V.read(spark, table, base, list(new), schema=landed.schema)
        if any(held[day]["runs"] for day in new):
            rows = rows.join(known.select(keys), keys, "left_anti")
        runs = _write_days(rows.select(known.columns), table)
        parts = {day: {"runs": held[day]["runs"] + ([runs[day]] if day in runs else []), "notes": {"merged": sorted(present[day])}} for day in new}
        if V.commit(spark, table, base, parts, known.schema) is not None:
            return merge_runs(spark, table, list(new), max_runs)


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key.  The keys are counted first, which moves them alone; whole rows are shuffled and sorted only if some key comes twice."""
    twice = rows.groupBy(*keys).count().where("count > 1")
    return rows.dropDuplicates(keys) if twice.count() else rows


def _write_days(rows: DataFrame, table: str) -> dict[str, dict]:
    order, time_col = cluster_columns(rows), time_column(rows)
    return V.write_run(ranged(rows, DAY, order, time_col), table, F.col(DAY), [*order, F.col(time_col).desc()], zone_columns(rows), BLOOM)


def merge_runs(spark: SparkSession, table: str, days: list[str] | None = None, max_runs: int = MAX_RUNS) -> int:
    """Rewrite days that have ``max_runs`` runs or more as one run each; the version afterwards."""
    while True:
        base = V.state(spark, table)
        parts = {day: V.part_of(spark, table, base, day) for day in (days or base["parts"])}
        parts = {day: part for day, part in parts.items() if len(part["runs"]) >= max(2, max_runs)}
        if not parts:
            return base["number"]
        rows = V.read(spark, table, base, list(parts))
        made = _write_days(rows, table)
        after = {day: part | {"runs": [V.merged_run(made[day], part["runs"])]} for day, part in parts.items()}
        number = V.commit(spark, table, base, after, rows.schema)
        if number is not None:
            return number


def retire(spark: SparkSession, landing: str, table: str, min_age_seconds: float = 24 * 3600) -> int:
    """Remove landing batches that the newest version holds, if they were written ``min_age_seconds`` ago; their number.

    A stream that writes such a batch once more (a replay) does no harm: its
    rows are known by their ids.
    """
    at, removed = V.state(spark, table), 0
    for day, batches in landing_batches(spark, landing).items():
        merged = set(V.part_of(spark, table, at, day)["notes"].get("merged", []))
        for name, (path, age) in batches.items():
            if name in merged and age >= min_age_seconds:
                V.delete(spark, path)
                removed += 1
    return removed


def read_history(spark: SparkSession, table: str, version: int | None = None, start: str | None = None, end: str | None = None,
                 user_id: int | None = None) -> DataFrame:
    """The history at a version (default the newest), with the time range and user of C1.

    Days outside the range, and files whose users or times lie outside, are
    not opened; the rows are filtered too.
    """
    ensure_utc(spark)
    at = V.state(spark, table, version)
    lo, hi = ((spark.range(1).select(F.lit(t).cast("timestamp").cast("string")).first()[0] if t else None) for t in (start, end))

    def in_days(day: str) -> bool:
        return (lo is None or day >= lo[:10]) and (hi is None or day <= hi[:10])

    def hit(zones: dict) -> bool:
        users, times = zones["user_id"], next((z for c, z in zones.items() if c != "user_id"), [None, None])
        if user_id is not None and (users[0] is None or not int(users[0]) <= user_id <= int(users[1])):
            return False  # a file without users has null users only
        return times[0] is None or ((lo is None or times[1] >= lo) and (hi is None or times[0] <= hi))

    rows = V.read(spark, table, at, in_days, hit)
    time_col = time_column(rows)
    if user_id is not None:
        rows = rows.where(F.col("user_id") == F.lit(user_id))
    if start:
        rows = rows.where(F.col(time_col) >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col(time_col) <= F.lit(end).cast("timestamp"))
    return rows


def main(argv: list[str] | None = None) -> None:
    """Command line: compact a landing folder, and on demand retire merged batches and remove old versions."""
    import argparse

    from ..session import build_session

    ap = argparse.ArgumentParser(description="Merge landed stream batches into the versioned day history.")
    ap.add_argument("--landing", required=True)
    ap.add_argument("--table", required=True)
    ap.add_argument("--days", nargs="*", help="only these days (YYYY-MM-DD)")
    ap.add_argument("--max-runs", type=int, default=MAX_RUNS)
    ap.add_argument("--retire", action="store_true", help="remove merged landing batches")
    ap.add_argument("--retire-age", type=float, default=24 * 3600, help="seconds")
    ap.add_argument("--vacuum", type=int, metavar="VERSIONS", help="keep this many versions")
    args = ap.parse_args(argv)
    spark = build_session(app_name="pulsegrid-compaction")
    print("version", compact(spark, args.landing, args.table, args.days, args.max_runs))
    if args.retire:
        print("retired", retire(spark, args.landing, args.table, args.retire_age))
    if args.vacuum:
        print("removed", V.vacuum(spark, args.table, args.vacuum))


if __name__ == "__main__":
    main()
