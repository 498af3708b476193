"""Queries over the TESTDATA tables with their DuckDB counterparts."""

from tidekeep.registry.base import REGISTRY, oracle_sql, queries  # noqa: F401
from tidekeep.registry import catalog, filters, jobs, runs, scalars, signals, streams  # noqa: F401
