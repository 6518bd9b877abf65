"""Broadcasting only what was counted and measured; spreading what few tasks would hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows up to which a narrow table (keys and a few numbers) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of its columns of variable length up to which it may be.
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows and ``most_bytes`` in strings, arrays and the like, else as it is (a shuffle join).

    ``df`` is evaluated for it: cut what is costly first. Rows are counted up to the bound only.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    wide = [f for f in df.schema.fields if isinstance(f.dataType, StringType | BinaryType | ArrayType | MapType | StructType)]
    if wide:
        size = lambda f: F.octet_length(f.name) if isinstance(f.dataType, StringType | BinaryType) else F.octet_length(F.to_json(F.struct(f.name)))
        if (df.agg(F.sum(sum((F.coalesce(size(f), F.lit(0)) for f in wide), F.lit(0)))).head()[0] or 0) > most_bytes:
            return df
    return F.broadcast(df)


def spread(df: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """``df`` over as many tasks as run at once, by a hash of ``key``, if ``scan``, the table it is read from, comes in fewer parts; else as it is."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key) if scan.rdd.getNumPartitions() < tasks else df
