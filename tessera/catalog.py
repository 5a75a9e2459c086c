"""Name to (query, oracle SQL) for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Add a query; without ``oracle`` it is held to tests only."""
    _QUERIES[name] = query
    if oracle:
        _ORACLES[name] = oracle


def _load() -> None:
    from tessera.plans import aggregates, exposure, ingest, joins, profiles, scalars, statistics  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
