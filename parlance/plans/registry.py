"""Registry of named queries: ``key -> (spark builder, DuckDB oracle SQL or None)``.

A builder takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables
(or data Spark derives from them).  The oracle is an equivalent SQL text DuckDB
runs on the same tables; ``None`` means the operator is not SQL-expressible and
is checked in tests against a brute-force model instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLE[key] = oracle
        return fn
    return deco


def _load_all() -> None:
    # Importing the plan modules fills the registry.
    from parlance.plans import (  # noqa: F401
        branch_queries, catalog_queries, contract_queries, memory_queries, mutation_queries, parsing_queries,
        profile_queries, retrieval_queries, scoring_queries, streaming_queries, turn_queries, turn_record_queries,
    )


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
