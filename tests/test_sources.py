"""Table paths and the shared folder."""

from __future__ import annotations

import os

import pytest

from pulsegrid import session
from pulsegrid.sources.tables import read_table, table_path


def test_folder_and_file_tables_are_found_on_any_path_form(spark, scratch):
    spark.range(3).write.parquet(os.path.join(scratch, "a.parquet"))
    spark.range(4).write.parquet(os.path.join(scratch, "b"))
    for root in (scratch, scratch + "/", "file://" + scratch):
        assert table_path(spark, root, "a").endswith("a.parquet")
        assert read_table(spark, root, "a").count() == 3
        assert read_table(spark, root, "b").count() == 4


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


def test_scratch_folder_is_the_applications_own(spark):
    path = session.scratch_path(spark, "t")
    assert spark.sparkContext.applicationId in path and session.scratch_path(spark, "t") != path
