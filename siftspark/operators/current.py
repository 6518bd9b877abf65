"""The current row of each key in a table that holds repeated and late deliveries."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.plans.bounds import BROADCAST_ROWS
from siftspark.plans.scratch import cut

BUCKETS = 1 << 22  #: of hashed keys; a broadcast of all of them takes about 100 MB


def current_rows(df: DataFrame, key: str, at: str, columns: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the one with the latest ``at``.

    One shuffle with a partial aggregate; meant for a few narrow columns. Rows without a key are
    dropped; a null ``at`` is older than any other; of rows equal in ``at`` the greatest one in
    column order is kept, so the result does not depend on row order. Columns other than ``key``,
    ``at`` and ``columns`` are dropped, so extra columns do no harm. Empty in, empty out.
    """
    columns = [c for c in (columns or df.columns) if c not in (key, at)]
    best = F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("__row")
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key))
        .agg(best)
        .select(key, *[F.col("__row")[c].alias(c) for c in (at, *columns)])
    )


def current_wide_rows(df: DataFrame, key: str, at: str, columns: list[str], bound: int = BROADCAST_ROWS) -> DataFrame:
    """As ``current_rows``, for wide columns (texts, vectors) of a table in which few keys repeat.

    Only keys are shuffled. Keys with several rows are found first; while they are at most ``bound``
    they are broadcast and just their rows are grouped, and all other rows stay where they are.
    Beyond that their buckets are, at most ``BUCKETS`` numbers, and the rows in such a bucket are grouped, some needlessly.
    """
    columns = [c for c in columns if c not in (key, at)]
    df = df.filter(F.col(key).isNotNull()).select(key, at, *columns)
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col(key).alias("__key"))
    again = cut(again)
    own = F.col(key)
    if again.limit(bound + 1).count() > bound:
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
        again, own = again.select(bucket("__key").alias("__key")).distinct(), bucket(key)
    hint = F.broadcast(again)
    once = df.join(hint, own == F.col("__key"), "left_anti")
    rest = df.join(hint, own == F.col("__key"), "left_semi")
    return once.unionByName(current_rows(rest, key, at, columns).select(df.columns))


