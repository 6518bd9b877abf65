"""Queries over the tables of a dataset folder, each with hand-written SQL that must agree."""

from siftspark.catalog import aggregates, clusters, filters, joins, lifecycle, more, rest, scalars, vectors, windows  # noqa: F401
from siftspark.catalog.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
