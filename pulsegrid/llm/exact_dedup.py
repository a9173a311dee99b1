"""Exact dedup by deterministic block naming (DataFrame operations only).

Each normalised text is cut into blocks of ``BLOCK`` bytes.  The distinct
blocks are sorted and numbered: a block's number is its name, equal blocks and
only equal blocks share it.  Then adjacent names are paired and the distinct
pairs are numbered again, level by level, until every document has one name.
Two documents are equal exactly if they end at the same level with the same
name, so no digest collision can join different texts.

Block texts cross the network once, already distinct per task.  A 64-bit hash
only carries a name back to its block's occurrences; hashes that more than one
distinct block shares are found over all blocks and joined by the block's
bytes instead.  Every join reads written tables on both sides, so AQE splits
the partition of a block, pair or text that holds a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, materialize, text_or_empty

BLOCK = 1024


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, WS_CLASS + "+", " ")


def _numbered(distinct: DataFrame, keys: list[str], name: str, drop: str = "") -> DataFrame:
    """Distinct keys, sorted within their partition, with a unique integer name each (written, less column ``drop``)."""
    return materialize(distinct.sortWithinPartitions(*keys)
                       .withColumn("name", F.monotonically_increasing_id()).drop(drop), name)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  Of rows with equal normalised text the one
    with the smallest id stays (null ids last); of rows that repeat that id
    too, one stays.  ``keep_id`` is the id of the row that stays.  An empty
    table gives an empty result.  ``route`` maps a block to its routing hash
    (tests pass a weak one; results do not depend on it).
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalise(text_or_empty(text_col)).alias("norm"))
    sized = base.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block)).cast("int"))

    def blocks(df: DataFrame, *keep: str) -> DataFrame:
        # the generator sits between the normalised text and its slices, so the text is normalised once a row
        cut = df.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        return (cut.withColumn("block", F.substring(F.col("norm").cast("binary"), F.col("pos") * block + 1, F.lit(block)))
                .select(*keep, "pos", "block").withColumn("h", route(F.col("block"))))

    # level 0: name the distinct blocks
    named = _numbered(blocks(sized).select("h", "block").distinct(), ["h", "block"], "block-names", drop="block")
    shared = materialize(named.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared-routes")
    if shared.isEmpty():
        names = named.select("h", F.lit(None).cast("binary").alias("witness"), "name")
        located = blocks(sized.withColumn("rid", F.monotonically_increasing_id())
                         .withColumn("sha", F.sha2("norm", 256)), "rid", "doc_id", "sha", "n")
        located = located.withColumn("witness", F.lit(None).cast("binary"))
    else:
        clash = _numbered(blocks(sized).join(shared, "h", "left_semi").select("h", "block").distinct(),
                          ["h", "block"], "shared-blocks")
        names = (named.join(shared, "h", "left_anti").select("h", F.lit(None).cast("binary").alias("witness"), "name")
                 .unionByName(clash.select("h", F.col("block").alias("witness"), (-1 - F.col("name")).alias("name"))))
        names = materialize(names, "block-names-split")
        located = blocks(sized.withColumn("rid", F.monotonically_increasing_id())
                         .withColumn("sha", F.sha2("norm", 256)), "rid", "doc_id", "sha", "n")
        located = (located.join(shared.withColumn("is_shared", F.lit(True)), "h", "left")
                   .withColumn("witness", F.when(F.col("is_shared"), F.col("block"))))
    first = F.col("pos") == 0
    located = materialize(located.select("rid", "pos", "n", "h", "witness", F.when(first, F.col("doc_id")).alias("doc_id"),
                                         F.when(first, F.col("sha")).alias("sha")), "blocks")

    # level by level: name adjacent pairs until one name is left of each document
    at = located.select("rid", "pos", "n", "h", "witness").alias("o").join(
        names.alias("m"), (F.col("o.h") == F.col("m.h")) & F.col("o.witness").eqNullSafe(F.col("m.witness")))
    at = materialize(at.select("rid", "pos", "n", "name"), "names-0")
    done, level = [], 0
    while True:
        done.append(at.where("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        open_ = at.where("n > 1")
        if open_.isEmpty():
            break
        level += 1
        odd = F.col("pos") % 2 == 1
        pairs = materialize(open_.groupBy("rid", F.shiftright("pos", 1).alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n"))
                            .agg(F.max(F.when(~odd, F.col("name"))).alias("left"),
                                 F.max(F.when(odd, F.col("name"))).alias("right")), f"pairs-{level}")
        pair_names = _numbered(pairs.select("left", "right").distinct(), ["left", "right"], f"pair-names-{level}")
        at = pairs.alias("p").join(pair_names.alias("m"), (F.col("p.left") == F.col("m.left"))
                                   & F.col("p.right").eqNullSafe(F.col("m.right")))
        at = materialize(at.select("rid", "pos", "n", "name"), f"names-{level}")

    identity = reduce(DataFrame.unionByName, done)
    rows = materialize(located.where("pos = 0").select("rid", "doc_id", "sha").join(identity, "rid"), "identities")
    groups = materialize(
        rows.groupBy("level", "name").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("row"))).alias("first"),
            F.count("*").alias("group_size")), "groups")
    return (rows.join(groups, ["level", "name"])
            .select("doc_id", F.col("first.id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256")))

