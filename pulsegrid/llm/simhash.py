"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits have, of their two
32-bit segments, one that differs in at most one bit.  So each distinct
fingerprint is indexed under every variant of a segment with one bit left out
(64 keys; the index is a bucketed table, so it is shuffled once), and
fingerprints that share a key are compared.  Equal fingerprints
are one index entry, however many documents share them.

A key shared by more than ``PAIRS_UP_TO`` fingerprints isn't expanded into
pairs.  Its members are indexed again under variants that leave out two bits of
the whole fingerprint in the ways the key allows (both in the other segment, or
one in each).  Such a key fixes 62 bits, so at most four fingerprints share it:
the work stays linear in the members and no link is lost.

Links become components by star contraction over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, materialize, small_batches, text_or_empty
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
PAIRS_UP_TO = 64
_PART = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer (0 for a text without words)."""
    words = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    data, ends = b" ".join(words), list(accumulate(map(len, words)))
    width = min(shingle, len(words))
    starts = [0] + [e + i + 1 for i, e in enumerate(ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[s:e + i], SEED) for s, e, i in zip(starts, ends[width - 1:], range(width - 1, len(words)))], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _PART):
        counts += np.unpackbits(hashes[i:i + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(ones.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; a null text has no words."""
    small_batches(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def text_hash(text_col: str = "text") -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text_or_empty(text_col))


def _without(fp: Column, bit: Column) -> Column:
    return fp.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)))


def _distance(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def links(fps: DataFrame, max_bits: int = MAX_BITS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) that join all those within ``max_bits`` of each other, directly or in a chain."""
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments and one wildcard find at most two differing bits")
    low = F.lit(0xFFFFFFFF)
    segment = F.when(F.col("bit") < 32, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    # key: which bit is left out, and the rest of its segment
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    keyed = keyed.select("fp", F.shiftleft(F.col("bit").cast("bigint"), 32).bitwiseOR(_without(segment, F.col("bit") % 32)).alias("key"))
    keyed = bucketed(keyed, "variants", int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")  # shuffled once
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variant-sizes")
    two = sizes.where("n = 2").select("a", "b")

    more = materialize(keyed.join(sizes.where("n > 2").select("key", "n"), "key"), "variant-members")
    few = more.where(F.col("n") <= pairs_up_to)
    some = (few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
            .where("a < b").select("a", "b"))

    many = more.where(F.col("n") > pairs_up_to).withColumn("bit", F.shiftright("key", 32).cast("int"))
    half = F.when(F.col("bit") < 32, 0).otherwise(32)     # first bit of the key's segment
    other = 32 - half
    one_each = many.select("fp", F.col("bit").alias("x"), F.explode(F.sequence(other, other + 31)).alias("y"))
    both_there = (many.select("fp", other.alias("o")).distinct()
                  .select("fp", "o", F.explode(F.sequence(F.col("o"), F.col("o") + 30)).alias("x"))
                  .select("fp", "x", F.explode(F.sequence(F.col("x") + 1, F.col("o") + 31)).alias("y")))
    pairs = one_each.unionByName(both_there).select("fp", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    at_most_four = (pairs.select("fp", "x", "y", _without(_without(F.col("fp"), F.col("x")), F.col("y")).alias("rest")).distinct()
                    .groupBy("x", "y", "rest").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    hot = (at_most_four.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b"))
    return two.unionByName(some).unionByName(hot).where(_distance("a", "b") <= max_bits).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, root, component_id.

    Fingerprints at most ``max_bits`` apart are linked; ``component_id`` is the
    smallest id reachable over links (null if no document of the component has
    an id) and ``root`` the smallest fingerprint.  Texts without words have fingerprint zero and are linked like any
    other.  Rows that repeat an id are reported each by their own text.  An
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits, pairs_up_to))
    rooted = materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    first = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "first-documents")
    named = materialize(rooted.join(first, "root").select("fp", "root", "component_id"), "named-fingerprints")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def heads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay if one of each component does: the smallest id (none last), then the smallest text hash.

    Rows repeated with that id and text become one (the smallest in the order of all their columns).
    """
    rows = near_dedup(docs, id_col, text_col, **options)
    one = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times")).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "times")).alias("x"))
    one = materialize(one.select(F.col("x.doc_id").alias("own_id"), F.col("x.text_hash").alias("own_hash"), "x.times"), "heads")

    def those(which: DataFrame) -> DataFrame:
        return docs.join(which, F.col(id_col).eqNullSafe(F.col("own_id")) & (text_hash(text_col) == F.col("own_hash")), "left_semi")

    out, again = those(one.where("times = 1")), one.where("times > 1")
    if again.isEmpty():
        return out
    whole = F.struct(*docs.columns)
    more = those(again).groupBy(F.col(id_col).alias("own_id"), text_hash(text_col).alias("own_hash")).agg(F.min(whole).alias("x"))
    return out.unionByName(more.select("x.*"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
