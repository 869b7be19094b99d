"""All queries of the engine, by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("event_queries", "relational_queries", "graph_queries", "text_queries", "quality_queries", "stream_queries", "catalog_queries", "claim_queries", "merge_queries", "placing_queries", "show_queries", "verify_queries", "entry_queries", "upkeep_queries", "detail_queries")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its own name."""

    def register(function):
        _QUERIES[function.__name__] = function
        if oracle:
            _ORACLES[function.__name__] = oracle
        return function

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tidemark.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
