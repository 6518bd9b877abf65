"""Newest-wins upsert of a batch into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftspark.operators.current import current_rows


def merge_upsert(old: DataFrame, new: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in: per key the row with the latest ``at``.

    Columns that one side lacks come out null. Rows with a null key are rejected. Either side may be empty or hold a key repeatedly.
    """
    return current_rows(old.unionByName(new, allowMissingColumns=True), key, at, columns)
