"""Registry of named queries, each with an optional DuckDB oracle SQL string.

A query is a callable ``(spark, sf_dir) -> DataFrame`` over the parquet tables
of one scale-factor directory.  ``oracle`` is ANSI/DuckDB SQL over the same
tables registered as views; omit it for model-training operators whose output
depends on an iterative fit (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise KeyError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all() -> None:
    # Importing the modules registers their queries.
    from shiftlab.plans import (  # noqa: F401
        q_charts,
        q_features,
        q_ingest,
        q_loop,
        q_metrics,
        q_models,
        q_rebalance,
        q_split,
        q_sweep,
    )
