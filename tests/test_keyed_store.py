"""Keyed tables: many writes at bounded runs, replays, crashes, writers at one time, point reads, absorbed stream batches."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.keyed import upsert_journal
from pulsegrid.plans.common import users_of
from pulsegrid.sources import fixtures as X
from pulsegrid.sources import keyed as KD
from pulsegrid.sources import stored as ST
from pulsegrid.sources import versions as V
from pulsegrid.streaming import sinks as K

from conftest import SF_SMALL


def _runs(spark, path):
    return V.part_of(spark, path, V.state(spark, path), KD.ALL)["runs"]


def _same(a, b):
    return a.count() == b.count() and a.exceptAll(b.select(*a.columns)).count() == 0


@pytest.fixture()
def journal(spark):
    rows = X.journal(spark, SF_SMALL).persist()
    yield rows
    rows.unpersist()


def test_many_writes_stay_few_runs(spark, scratch, journal):
    path = f"{scratch}/journal"
    for n in range(14):
        KD.append(journal.where(F.col("seq") % 14 == n), path, KD.JOURNAL, "w", n, fanout=3)
        assert len(_runs(spark, path)) <= 2 * 3  # fanout - 1 a level
    levels = sorted(r["level"] for r in _runs(spark, path))
    assert levels == [0, 0, 1, 2]  # 14 = 9 + 3 + 1 + 1
    assert _same(KD.read(spark, path, KD.JOURNAL), upsert_journal(journal, journal.limit(0)))


def test_replayed_write_adds_nothing(spark, scratch, journal):
    path = f"{scratch}/journal"
    first, second = journal.where("seq % 2 = 0"), journal.where("seq % 2 = 1")
    for rows, n in ((first, 0), (second, 1), (first, 0), (second, 1)):
        number = KD.append(rows, path, KD.JOURNAL, "w", n)
    assert number == 2 and len(_runs(spark, path)) == 2
    KD.append(first, path, KD.JOURNAL, "another", 0)  # the same rows by another writer fold away
    assert _same(KD.read(spark, path, KD.JOURNAL), upsert_journal(journal, journal.limit(0)))


def test_crash_while_merging_leaves_the_runs(spark, scratch, journal, monkeypatch):
    path, real = f"{scratch}/journal", V.commit
    KD.append(journal.where("seq % 2 = 0"), path, KD.JOURNAL, "w", 0, fanout=2)

    def commit(s, p, base, parts, *a):
        if any(r["level"] for r in parts[KD.ALL]["runs"]):
            raise RuntimeError("lost driver")
        return real(s, p, base, parts, *a)

    with monkeypatch.context() as m:
        m.setattr(V, "commit", commit)
        with pytest.raises(RuntimeError):
            KD.append(journal.where("seq % 2 = 1"), path, KD.JOURNAL, "w", 1, fanout=2)
    want = upsert_journal(journal, journal.limit(0))
    assert _same(KD.read(spark, path, KD.JOURNAL), want) and len(_runs(spark, path)) == 2
    KD.merge_levels(spark, path, KD.JOURNAL, 2)
    assert _same(KD.read(spark, path, KD.JOURNAL), want) and [r["level"] for r in _runs(spark, path)] == [1]
    assert V.vacuum(spark, path, keep_versions=1, grace_seconds=-1) == 3
    assert _same(KD.read(spark, path, KD.JOURNAL), want)


def test_two_writers_at_one_time_lose_nothing(spark, scratch, journal, monkeypatch):
    path, real, met = f"{scratch}/journal", V.commit, []

    def commit(*args):
        if not met:
            met.append(True)
            KD.append(journal.where("seq % 2 = 1"), path, KD.JOURNAL, "b", 0)
        return real(*args)

    monkeypatch.setattr(V, "commit", commit)
    KD.append(journal.where("seq % 2 = 0"), path, KD.JOURNAL, "a", 0)
    assert _same(KD.read(spark, path, KD.JOURNAL), upsert_journal(journal, journal.limit(0)))


def test_point_read_opens_few_files(spark, scratch, journal):
    path = f"{scratch}/journal"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        KD.append(journal, path, KD.JOURNAL, "w", 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    every, one = KD.read(spark, path, KD.JOURNAL), KD.read(spark, path, KD.JOURNAL, 7)
    assert 0 < len(one.inputFiles()) <= 2 < len(every.inputFiles())
    assert _same(one, upsert_journal(journal, journal.limit(0)).where("user_id = 7"))
    assert KD.read(spark, path, KD.JOURNAL, 10 ** 9).count() == 0


def test_links_and_chat(spark, scratch):
    users = spark.createDataFrame([(1, "old"), (2, "old")], "user_id long, contact_id string")
    links = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 9, "c")], "seq long, user_id long, contact_id string")
    KD.append(links.where("seq = 2"), f"{scratch}/contact_links", KD.CONTACT_LINKS, "w", 0)
    KD.append(links.where("seq <> 2"), f"{scratch}/contact_links", KD.CONTACT_LINKS, "w", 1)  # an older number later
    got = {r.user_id: r.contact_id for r in ST.stored_users(spark, users, scratch).collect()}
    assert got == {1: "b", 2: "old"}
    assert users_of(spark, SF_SMALL).count() == ST.stored_users(spark, users_of(spark, SF_SMALL), scratch).count()


def test_stream_documents_are_absorbed_once(spark, scratch):
    docs = spark.createDataFrame([(f"d{i % 5}", float(i)) for i in range(20)], "doc_id string, avg_value double")
    landing, path, schema = f"{scratch}/docs", f"{scratch}/table", "doc_id string, avg_value double, batch_id bigint"
    for batch in range(4):
        K.write_batch(docs.where(F.floor(F.col("avg_value") / 5) == batch), landing, "w", batch, "json")
        if batch % 2:
            KD.absorb(spark, landing, path, KD.AGG_DOCS, schema)
            assert KD.retire(spark, landing, path, 0) == 2
    assert KD.absorb(spark, landing, path, KD.AGG_DOCS, schema) == 2
    K.write_batch(docs.where("avg_value < 5"), landing, "w", 0, "json")  # a replay of what was retired
    KD.absorb(spark, landing, path, KD.AGG_DOCS, schema)
    assert sorted((r.doc_id, r.avg_value) for r in KD.read(spark, path, KD.AGG_DOCS).collect()) == [(f"d{i}", 15.0 + i) for i in range(5)]
    assert os.listdir(f"{path}/versions")
