"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from siftspark.operators.current import current_rows, current_wide_rows
from siftspark.plans.bounds import spread
from siftspark.sources.tables import table

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: Current rows of each table, for the SQL side. Names end in _now.
NOW = """posts_now AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collected_at DESC) AS rn FROM posts WHERE id IS NOT NULL) WHERE rn = 1),
filtered_now AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY filtered_at DESC) AS rn FROM filtered_posts WHERE id IS NOT NULL) WHERE rn = 1),
events_now AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC) AS rn FROM pain_events WHERE id IS NOT NULL) WHERE rn = 1),
emb_now AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pain_event_id ORDER BY created_at DESC) AS rn FROM pain_embeddings WHERE pain_event_id IS NOT NULL) WHERE rn = 1)"""


class Tables:
    """The tables of a folder; ``posts``, ``filtered``, ``events`` and ``embeddings`` hold current rows only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    def posts(self, *columns: str) -> DataFrame:
        return self._now("posts", "id", "collected_at", columns, {"title", "body", "platform_data"})

    def filtered(self, *columns: str) -> DataFrame:
        return self._now("filtered_posts", "id", "filtered_at", columns, set())

    def events(self, *columns: str) -> DataFrame:
        return self._now("pain_events", "id", "extracted_at", columns, set())

    def embeddings(self, *columns: str) -> DataFrame:
        return self._now("pain_embeddings", "pain_event_id", "created_at", columns, {"embedding_vector"})

    def _now(self, name, key, at, columns, wide) -> DataFrame:
        if wide & set(columns):
            return spread(current_wide_rows(self.raw(name), key, at, list(columns)), self.raw(name, key), key)
        return current_rows(self.raw(name), key, at, list(columns))

    @cached_property
    def clusters(self) -> DataFrame:
        return self.raw("clusters")

    @cached_property
    def opportunities(self) -> DataFrame:
        return self.raw("opportunities")


def query(name: str, sql: str | None = None, now: bool = True):
    """Register ``f(tables) -> DataFrame``; ``sql`` may use the _now tables."""

    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(spark, folder))

        run.__doc__ = f.__doc__
        run.__name__ = name
        _QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if now:
                body = f"WITH {NOW},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {NOW}\n{body}"
            _SQL[name] = body
        return f

    return register


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def values(rows, names: str) -> str:
    """A SQL VALUES list of constants as a table ``names``."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) {names}"
