"""Joins and key checks (J1 and J1 as of a time, J2, J4, J5, K8).

The reference looks users up one key at a time; here they are equi-joins on
``user_id``.  No broadcast hint is forced: Catalyst broadcasts the user side
when its estimated size is under ``spark.sql.autoBroadcastJoinThreshold``
(the size check) and otherwise plans a sort-merge join, and AQE re-plans at
run time and splits a skewed user's partition (``skewJoin``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def route_alerts(alerts: DataFrame, users: DataFrame, how: str = "left") -> DataFrame:
    """Alert -> contact id of its user; alerts without a user id are dropped.

    ``how='left'`` keeps alerts whose user has no contact (they stay off the
    chat channel, ``contact_id`` null); ``how='inner'`` keeps deliverable ones.
    """
    contacts = users.select("user_id", "contact_id")
    routed = alerts.where(F.col("user_id").isNotNull()).join(contacts, "user_id", how)
    if how == "inner":
        routed = routed.where(F.col("contact_id").isNotNull())
    return routed


def route_alerts_as_of(alerts: DataFrame, links: DataFrame, time_col: str = "created_at") -> DataFrame:
    """J1 as of the alert's time: each alert with the contact id that was linked when it was raised (null if none was).

    ``links``: user_id, contact_id, linked_at, seq; of links at one time the
    greatest ``seq`` holds, and a link at the alert's own time counts.  In
    which order links were recorded plays no part.  Alerts without a user id
    are dropped.

    Alerts and links of a user are put in order day by day: the last link of
    every day is carried to the user's next days in a table of at most a row a
    user and day, so a user with a third of all alerts is many groups.
    """
    day = lambda c: F.to_date(F.col(c))
    own = alerts.where(F.col("user_id").isNotNull())
    carried = own.columns
    one = links.where(F.col("user_id").isNotNull() & F.col("linked_at").isNotNull()).groupBy("user_id", "linked_at").agg(
        F.max(F.struct("seq", "contact_id"))["contact_id"].alias("contact_id"))
    link = F.struct(F.col("linked_at").alias("at"), F.col("contact_id").alias("contact"))
    marks = one.select("user_id", day("linked_at").alias("_day"), link.alias("_link")).groupBy("user_id", "_day").agg(F.max("_link").alias("_last"))
    days = marks.unionByName(own.select("user_id", day(time_col).alias("_day")).distinct(), allowMissingColumns=True)
    days = days.groupBy("user_id", "_day").agg(F.max("_last").alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    opening = days.select("user_id", "_day", before.alias("_last")).where("_last IS NOT NULL").select(
        "user_id", "_day", F.lit(None).cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.col("_last.contact").alias("_contact"))
    moves = one.select("user_id", day("linked_at").alias("_day"), F.col("linked_at").alias("_at"), F.lit(0).alias("_kind"), F.col("contact_id").alias("_contact"))
    asks = own.select("user_id", day(time_col).alias("_day"), F.col(time_col).alias("_at"), F.lit(1).alias("_kind"), F.struct(*carried).alias("_alert"))
    every = opening.unionByName(moves).unionByName(asks, allowMissingColumns=True).withColumn("_held", F.when(F.col("_kind") == 0, F.struct("_contact")))
    within = Window.partitionBy("user_id", "_day").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = every.withColumn("contact_id", F.last("_held", ignorenulls=True).over(within)["_contact"])
    return held.where("_kind = 1").select(*[F.col("_alert")[c].alias(c) for c in carried], "contact_id")


def lookup_users(ids: DataFrame, users: DataFrame) -> DataFrame:
    """User rows for requested ids; ``found`` false where the id does not exist."""
    marked = users.withColumn("_hit", F.lit(True))
    return ids.select("user_id").join(marked, "user_id", "left").withColumn(
        "found", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def orphans(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose user does not exist (referential violations)."""
    return df.join(users.select(F.col("user_id").alias(key)), key, "left_anti")


def known(df: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose user exists."""
    return df.join(users.select(F.col("user_id").alias(key)), key, "left_semi")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def link_contacts(users: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8: apply contact-id updates by user id -> (updated users, unknown ids).

    Of several updates for one user the last (greatest ``seq``) wins.
    """
    upd = links.groupBy("user_id").agg(F.max(F.struct("seq", "contact_id"))["contact_id"].alias("_new"))
    updated = users.join(upd, "user_id", "left").withColumn(
        "contact_id", F.coalesce(F.col("_new"), F.col("contact_id"))).drop("_new")
    unknown = upd.join(users.select("user_id"), "user_id", "left_anti").select(
        "user_id", F.col("_new").alias("contact_id"))
    return updated, unknown
