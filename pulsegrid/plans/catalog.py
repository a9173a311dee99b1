"""

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables; its
oracle is DuckDB SQL over the same tables with the same column names.
Queries without an oracle get the weaker rows-only check.
"""

from __future__ import annotations

import importlib
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = ["q_ingest", "q_rules", "q_aggregates", "q_history", "q_joins", "q_keyed", "q_render", "q_ml", "q_stored", "q_stream"]


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    for mod in _MODULES:
        importlib.import_module(f"{__package__}.{mod}")


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
