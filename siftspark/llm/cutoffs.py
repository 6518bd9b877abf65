"""A score cutoff per group that keeps a target share, by iterative histogram refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut

BINS = 256  #: bins per group and round
MOST_ROUNDS = 40  #: a double's range ends after far fewer


def cutoffs(scores: DataFrame, group: list[str], score: str, permille: str) -> DataFrame:
    """(group..., n, target, cutoff, kept) for rows (group..., score, permille).

    The cutoff is the highest score that at least ``target = ceil(n * permille / 1000)`` rows reach; ``kept`` counts all
    that reach it, ties included. Rows with a null or NaN score, a null permille or a null in the group are left out. A target
    of 0 gives a null cutoff and keeps none. Each round counts a group's rows into ``BINS`` equal bins between the
    bounds still open, map-side first, and zooms into the bin that holds the target rank; a bin whose least and
    greatest score agree is the answer, so the result is exact. A group, however hot, only moves counts.
    """
    usable = F.col(score).isNotNull() & ~F.isnan(score) & F.col(permille).isNotNull()
    for g in group:
        usable &= F.col(g).isNotNull()
    rows = scores.filter(usable).select(*group, score, permille)
    state = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(permille).alias("__p"), F.min(score).alias("lo"), F.max(score).alias("hi"))
    state = state.withColumn("target", F.expr("(n * __p + 999) div 1000")).drop("__p")
    state = cut(state.withColumn("above", F.lit(0).cast("long")))
    done = []
    for _ in range(MOST_ROUNDS):
        done.append(state.filter("lo = hi OR target = 0"))
        live = state.filter("lo < hi AND target > 0")
        if not live.head(1):
            break
        width = (F.col("hi") - F.col("lo")) / BINS
        place = F.least(F.floor((F.col(score) - F.col("lo")) / width), F.lit(BINS - 1)).cast("int")
        inside = rows.join(bounded(live), group).filter(F.col(score).between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy(*group, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min(score).alias("blo"), F.max(score).alias("bhi"))
        down = Window.partitionBy(*group).orderBy(F.desc("bin"))
        bins = bins.withColumn("upto", F.sum("c").over(down)).join(live.select(*group, "n", "target", "above"), group)
        holds = (F.col("above") + F.col("upto") >= F.col("target")) & (F.col("above") + F.col("upto") - F.col("c") < F.col("target"))
        nxt = bins.filter(holds).select(*group, "n", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), "target", (F.col("above") + F.col("upto") - F.col("c")).alias("above"))
        state = cut(nxt)
    else:
        raise RuntimeError("histogram refinement did not end")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(*group, "n", "target", F.when(F.col("target") > 0, F.col("lo")).alias("cutoff"))
    reach = rows.join(bounded(cut(out.select(*group, "cutoff"))), group).filter(F.col(score) >= F.col("cutoff"))
    kept = reach.groupBy(*group).agg(F.count(F.lit(1)).alias("kept"))
    return out.join(kept, group, "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))


