"""Canonical spellings of names in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``str.strip`` and Spark's ``trim`` disagree on: every white space is cut.
_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, _EDGES, "")


def subreddit_name(col: Column) -> Column:
    """Trimmed, lower-cased, without a leading ``r/`` or ``/r/``; null for null, may be blank."""
    return trimmed(F.regexp_replace(F.lower(trimmed(col)), r"^/?r/", ""))


def author_name(col: Column) -> Column:
    """Trimmed, lower-cased, without a leading ``u/``; null for null, may be blank."""
    return trimmed(F.regexp_replace(F.lower(trimmed(col)), r"^u/", ""))


def source_name(col: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(trimmed(col))
