"""Corpus pipeline: quality, line dedup, near-dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read back as the next stage's ``docs``.  All stages but the last
give the columns of ``documents``.  ``docs`` may have null in any column, empty
and very long texts, repeated rows, more columns (they are not read) or no
rows; each stage says what it makes of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, line_dedup, mixing, quality, simhash
from pulsegrid.llm.common import load, materialize
from pulsegrid.llm.queries import PATTERN, RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1 (score 0.7 or more).

    The model learns from the rows of ``docs`` that ``labels`` covers and that
    aren't held out; if there are none, nothing can be judged and every row stays.
    Rows are judged by their text alone; null counts as empty.
    """
    docs = docs.select(COLUMNS)
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    if model == quality.UNTRAINED:
        return docs
    scored = quality.classify(docs, model, keep=COLUMNS)
    return scored.where("predicted = 1").select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document has; ``n_chars`` follows the text.

    All rows stay, also those left without a line; a null text comes back empty.
    """
    out = line_dedup.line_dedup(docs.select(COLUMNS), keep=["lang", "source"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (rows without an id last).

    Rows repeated with that id and text become one.  Texts without words are
    near copies of each other.
    """
    return simhash.heads(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (up to three times, or not at all).

    The mix counts words; a document at its source's cut is taken once more if
    the mix takes at least half its words.  Documents without words aren't taken.
    """
    rows = mixing.mix(docs.select(COLUMNS), keep=COLUMNS).rows
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    taken = rows.withColumn("copies", copies).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids (packed little-endian 32-bit), their number and digest, and the digest of the decoded bytes."""
    return bpe.round_trip(docs.select(COLUMNS), RANKS, PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

# The classifier, the fingerprints and the tokens have no SQL form: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
