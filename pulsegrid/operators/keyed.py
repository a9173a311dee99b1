"""Keyed writes and request validation.

Upserts are aggregations on the key (``max`` over a struct led by the
sequence), so they combine map-side and never gather a key's history in one
task; re-running them on the same inputs gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

JOURNAL_VALUES = ["mood", "stress_level", "caffeine_after_17", "alcohol", "screens_min_before_bed", "notes"]


def upsert_journal(base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("user_id", "entry_date"),
                   seq: str = "seq") -> DataFrame:
    """K7: union, then per key the values of the highest ``seq`` win and the first ``created_at`` stays."""
    both = base.unionByName(new, allowMissingColumns=True)
    latest = F.max(F.struct(F.col(seq).alias("_seq"), *[F.col(c) for c in JOURNAL_VALUES]))
    agg = both.groupBy(*keys).agg(latest.alias("_l"), F.min("created_at").alias("created_at"))
    return agg.select(*keys, F.col("_l._seq").alias(seq), *[F.col(f"_l.{c}").alias(c) for c in JOURNAL_VALUES],
                      "created_at")


def exchange_to_turns(exchanges: DataFrame) -> DataFrame:
    """K9: one exchange (user message + assistant reply) -> two chat rows sharing a session id.

    The session id is a deterministic hash of (user, exchange id), so a replay
    writes the same rows.  A side that is missing (no reply yet) has no row.
    """
    session = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("exchange_id").cast("string")))
    turns = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("user").alias("role"), F.col("message").alias("content")),
        F.struct(F.lit(1).alias("pos"), F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    return exchanges.select("user_id", "exchange_id", "created_at", session.alias("session_id"),
                            F.inline(turns)).where(F.col("content").isNotNull()).select(
        "user_id", "exchange_id", "pos", "role", "content", "created_at", "session_id")


def chat_rows(turns: DataFrame) -> DataFrame:
    """K9 rows as the chat table keeps them: the row id sorts a session's messages in their order."""
    return turns.select("user_id", "created_at", "role", "content", "session_id",
                        F.concat_ws("-", "session_id", F.col("pos").cast("string")).alias("row_id"))


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in checks]), lambda x: x.isNotNull())


def validate_requests(df: DataFrame) -> DataFrame:
    """Predict requests with ``sleep_disorder`` defaulted and a ``reasons`` array (empty = valid)."""
    df = df.withColumn("sleep_disorder", F.coalesce(F.col("sleep_disorder"), F.lit(C.DEFAULT_SLEEP_DISORDER)))
    checks = []
    for name, (lo, hi) in C.PREDICT_RANGES.items():
        checks.append((F.col(name).isNull(), f"{name} missing"))
        checks.append((~F.col(name).between(lo, hi), f"{name} out of range"))
    for name, allowed in C.PREDICT_ENUMS.items():
        checks.append((F.col(name).isNull() | ~F.col(name).isin(allowed), f"{name} not allowed"))
    return df.withColumn("reasons", _reasons(checks))


def split_valid_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = validate_requests(df)
    ok = F.size("reasons") == 0
    return v.where(ok).drop("reasons"), v.where(~ok)


def validate_journal(df: DataFrame) -> DataFrame:
    """Journal entries with defaults applied and a ``reasons`` array (empty = valid)."""
    df = df.withColumns({
        "caffeine_after_17": F.coalesce(F.col("caffeine_after_17"), F.lit(False)),
        "alcohol": F.coalesce(F.col("alcohol"), F.lit(False)),
        "screens_min_before_bed": F.coalesce(F.col("screens_min_before_bed"), F.lit(0)),
    })
    checks = [
        (F.col("mood").isNull(), "mood missing"),
        (~F.col("mood").between(*C.JOURNAL_MOOD), "mood out of range"),
        (F.col("stress_level").isNull(), "stress_level missing"),
        (~F.col("stress_level").between(*C.JOURNAL_STRESS), "stress_level out of range"),
        (~F.col("screens_min_before_bed").between(*C.JOURNAL_SCREENS), "screens_min_before_bed out of range"),
    ]
    return df.withColumn("reasons", _reasons(checks))


def split_valid_journal(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = validate_journal(df)
    ok = F.size("reasons") == 0
    return v.where(ok).drop("reasons"), v.where(~ok)
