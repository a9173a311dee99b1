"""Registered queries against their SQL oracles, and the pipeline's stages against plain versions."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline as P
import pytest
from pulsegrid.llm import queries, quality
from pulsegrid.llm.common import load, materialize
from test_llm_operators import brute_lines, brute_fingerprint, corpus, frame, linked, result

import oracle_harness as H

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    problems, rows, _ = H.compare(spark, H.duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert not problems and rows


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    """Each stage on all that its predecessor kept, rows held against plain versions of the stage."""
    docs = load(spark, SF, "documents")
    before = docs
    scores = quality.classify(docs, quality.train(docs, load(spark, SF, "labels"))).where("predicted = 1")
    kept = materialize(P.STAGES[0][1](spark, before, SF), "t")
    assert kept.columns == P.COLUMNS
    assert result(kept, "doc_id") == result(scores, "doc_id")

    lines = materialize(P.STAGES[1][1](spark, kept, SF), "t")
    assert lines.columns == P.COLUMNS and lines.count() == kept.count()
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    from pyspark.sql import functions as F
    assert result(lines.withColumn("s", F.sha2("text", 256)), "doc_id", "s") == [(i, s) for i, _, _, s in want]

    near = materialize(P.STAGES[2][1](spark, lines, SF), "t")
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in lines.collect()]
    root = linked({f for _, f in fps}, 2)
    first = {}
    for i, f in fps:
        first[root[f]] = min(first.get(root[f], i), i)
    assert near.columns == P.COLUMNS and [r[0] for r in result(near, "doc_id")] == sorted(first.values())

    mixed = materialize(P.STAGES[3][1](spark, near, SF), "t")
    assert mixed.columns == P.COLUMNS
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3 and set(times) <= set(first.values())

    tokens = P.STAGES[4][1](spark, mixed, SF)
    assert tokens.count() == mixed.count()


def test_stages_on_odd_rows(spark):
    rows = corpus()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    root = materialize(labels, "labels")  # noqa: F841
    import os
    import tempfile
    sf = tempfile.mkdtemp()
    labels.write.parquet(os.path.join(sf, "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, table, sf).count() <= 3 * len(rows)


@pytest.mark.parametrize("case", ["empty", "held out", "other ids"])
def test_quality_stage_without_training_rows(spark, scratch, case):
    docs = frame(spark, corpus())
    ids = {"empty": [], "held out": [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2], "other ids": range(9000, 9040)}[case]
    spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    kept = P.quality_classifier(spark, docs, scratch)
    assert kept.columns == P.COLUMNS and result(kept, "doc_id", "text") == result(docs, "doc_id", "text")
