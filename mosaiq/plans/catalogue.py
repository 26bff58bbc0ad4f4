"""The registered queries: a DataFrame plan for each name, with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated plan under ``name``."""

    def register(plan):
        _QUERIES[name] = plan
        if sql is not None:
            _ORACLES[name] = sql
        return plan

    return register


def _load() -> None:
    from mosaiq.plans import footprints, geometry, imaging, labelled, naming, pictures, relational, tallies  # noqa: F401  they register on import


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
