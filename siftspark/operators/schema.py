"""Additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evolve(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with those of ``columns`` (name: type, default) that it lacks, each holding its default; present ones stay as they are."""
    have = set(df.columns)
    return df.withColumns({name: F.lit(default).cast(kind) for name, (kind, default) in columns.items() if name not in have})
