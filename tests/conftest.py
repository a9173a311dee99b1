"""Shared test session: local mode, UTC, a private checkpoint folder only if none is configured."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pulsegrid.session import build_session

    conf = {"spark.driver.memory": "4g"}
    s = build_session(app_name="pulsegrid-tests", master="local[4]", shuffle_partitions=4, conf=conf)
    if not s.sparkContext.getConf().get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
