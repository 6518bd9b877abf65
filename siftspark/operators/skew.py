"""Per-key results although a few keys hold most rows: fragment and replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Placement:
    """Where rows go: the tasks of every heavy key, by shard; all other keys go to one task by hash."""

    tasks: int
    shards: dict[str, list[int]]

    def shard_count(self, key: Column) -> Column:
        return self._lookup({k: len(v) for k, v in self.shards.items()}, key, 1)

    def task(self, key: Column, shard: Column) -> Column:
        """The task of a shard of a key."""
        light = F.pmod(F.xxhash64(key), F.lit(self.tasks)).cast("int")
        if not self.shards:
            return light
        lists = F.create_map(*[x for k, v in sorted(self.shards.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
        return F.coalesce(F.element_at(F.try_element_at(lists, key), shard + 1), light)

    def _lookup(self, values: dict, key: Column, default) -> Column:
        if not values:
            return F.lit(default)
        return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))]), key), F.lit(default))


def placement(rows: DataFrame, key: str, tasks: int | None = None, grain: int = 4) -> Placement:
    """Bin-pack the heavy keys of ``rows`` onto ``tasks``.

    A key is heavy from a ``grain``-th of a task's fair share on, so there are at most ``grain * tasks`` such keys, and
    only they reach the driver, with counts over all rows (map-side first). Each is cut into shards of at
    most that size, in proportion to its load, and shards go to the least loaded task, largest
    first. The other keys start every task with the same share. Null keys count as light ones.
    """
    tasks = tasks or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    load = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = load.agg(F.sum("n")).head()[0] or 0
    unit = max(1.0, total / tasks / grain)
    heavy = load.filter((F.col("n") > unit) & F.col(key).isNotNull()).orderBy(F.desc("n"), key).limit(grain * tasks).collect()
    light = total - sum(r["n"] for r in heavy)
    free = [(light / tasks, t) for t in range(tasks)]
    shards: dict[str, list[int]] = {}
    for r in heavy:
        pieces = min(tasks, -(-r["n"] // max(1, int(unit))))
        for _ in range(pieces):
            used, t = heapq.heappop(free)
            shards.setdefault(r[key], []).append(t)
            heapq.heappush(free, (used + r["n"] / pieces, t))
    return Placement(tasks, shards)


def top_per_key(rows: DataFrame, key: str, order: list[Column], k: int, spread: str, place: Placement | None = None) -> DataFrame:
    """The first ``k`` rows of each key in ``order`` (a total order), all of them if fewer.

    Rows travel to the task of their shard, chosen by a hash of the column ``spread``; each task keeps the first ``k`` rows of each
    key it holds, and only these meet again by key. Rows with a null key are left out. Empty in, empty out.
    """
    rows = rows.filter(F.col(key).isNotNull())
    place = place or placement(rows, key)
    shard = F.pmod(F.xxhash64(spread), place.shard_count(F.col(key))).cast("int")
    placed = rows.withColumn("__task", place.task(F.col(key), shard)).repartitionById(place.tasks, F.col("__task"))
    first = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__task", key).orderBy(*order))).filter(F.col("__r") <= k)
    last = first.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= k)
    return last.drop("__task", "__r")


def join_by_load(rows: DataFrame, other: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` on ``key``, heavy keys of ``rows`` cut into shards, ``other`` replicated to just these.

    ``how`` is ``inner`` or ``left``. Null keys match nothing. ``spread`` is a column of ``rows`` whose hash chooses the shard.
    Columns of ``other`` must differ from those of ``rows`` but for the key.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    place = placement(rows, key)
    shards = place.shard_count(F.col(key))
    left = rows.withColumn("__s", F.pmod(F.xxhash64(spread), shards).cast("int"))
    left = left.withColumn("__task", place.task(F.col(key), F.col("__s"))).repartitionById(place.tasks, F.col("__task"))
    right = other.withColumn("__s", F.explode(F.sequence(F.lit(0), shards.cast("int") - 1)))
    right = right.withColumn("__task", place.task(F.col(key), F.col("__s"))).repartitionById(place.tasks, F.col("__task"))
    return left.join(right, ["__task", "__s", key], how).drop("__task", "__s")
