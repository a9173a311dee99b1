"""Every registered query against its DuckDB oracle (or a rows-only run) on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from pulsegrid.plans import catalog  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

QUERIES = catalog.queries()  # the optional subpackage tests its own
ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    problems, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_SMALL)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0
    assert df.columns


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["window_start", "window_end", "user_id", "metric", "avg_value", "min_value",
                          "max_value", "n_samples"]
    assert df.count() > 0


def test_entry_module_has_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 100


def test_query_names_follow_the_survey_ids():
    import re
    for name, fn in QUERIES.items():
        assert re.fullmatch(r"[sprtacjkfmw]\d+_[a-z0-9_]+", name), name
        assert "pipeline" not in name and not re.match(r"op\d+_", name)
        assert (fn.__doc__ or "").strip(), f"{name} has no docstring"
