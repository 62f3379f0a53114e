"""Registry of runnable queries: one per operator, each with the SQL that recomputes it where SQL can."""

from __future__ import annotations

import importlib

from paymatch.plans.oracle_base import oracle
from paymatch.plans.runtime import broadcast_by_measured_size
from paymatch.sources.fixtures import Fixtures

QUERIES: dict = {}
_FIXTURES: dict = {}


def fixtures(spark, sf_dir: str) -> Fixtures:
    """One set of derived views per session and folder; its staged results are shared by the queries."""
    broadcast_by_measured_size(spark)
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixtures(spark, str(sf_dir))
    return _FIXTURES[key]


def forget_fixtures() -> None:
    """Start over, so that the next query derives everything from the given tables again."""
    _FIXTURES.clear()


_SQL: dict[str, tuple[str, dict | None]] = {}


def query(name: str, sql: str | None = None, instead: dict[str, str] | None = None):
    """Register `fn(fixtures) -> DataFrame` under `name`; `instead` replaces tables that the SQL is built on."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(fixtures(spark, sf_dir))
        if sql is not None:
            _SQL[name] = (sql, instead)
        return fn
    return wrap


def oracle_sql() -> dict[str, str]:
    return {name: oracle(*text) for name, text in _SQL.items()}


for _module in ("queries_views", "queries_text", "queries_extraction", "queries_match", "queries_checks",
                "queries_decision", "queries_audit", "queries_rerun", "queries_import", "queries_stream"):
    try:
        importlib.import_module(f"paymatch.plans.{_module}")
    except ModuleNotFoundError as missing:
        if missing.name != f"paymatch.plans.{_module}":
            raise
