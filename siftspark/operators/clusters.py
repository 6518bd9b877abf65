"""Clusters that grow: similar existing ones, exact duplicates of a set, merging, and online assignment of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators import vector as V
from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut

SIMILAR = 0.75  #: cosine of centroids, and vote of neighbours, from which a cluster takes members in
FORM, OTHERS = 0.7, 3  #: a new cluster needs so many others of at least this cosine
LEAST = 4  #: events of a proposed group


def similar_existing(groups: DataFrame, clusters: DataFrame, dim: int, floor: float = SIMILAR, days: int = 7, least: int = 3) -> DataFrame:
    """(grp, cluster_id, cosine): for each of ``groups`` (grp long, v) the newest of ``clusters`` (id, v, size, created_at) whose centroid reaches ``floor``; none if there is none.

    Only clusters of at least ``least`` members created within ``days`` of the newest one take part, the first that is similar enough by falling
    ``created_at``, then id, not the most similar. A null ``created_at`` is never recent. A cluster is not similar to the group of its own id.
    """
    now = clusters.agg(F.max("created_at")).head()[0]
    recent = clusters.filter((F.col("size") >= least) & (F.col("created_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")))
    # ranks of the recent clusters: their places by creation as seconds, ids decide among equal ones
    rank = -(F.unix_micros(F.col("created_at").cast("timestamp")))
    again = recent.withColumn("rank", rank)
    ties = Window.partitionBy("rank").orderBy("id")
    again = again.withColumn("rank", F.col("rank") + F.row_number().over(ties) - 1)
    found = V.first_similar(groups.select(F.col("grp").alias("id"), "v"), again.select("id", "v", "rank"), dim, floor)
    return found.select(F.col("query").alias("grp"), F.col("id").alias("cluster_id"), "cosine")


def equal_sets(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """(left_group, right_group) of groups (group, member) with equal sets of members; repeated members count once, null ones not at all.

    Sizes and two commutative sums of member hashes select the pairs, by partial aggregates however large a group is; that all members agree is then counted.
    """

    def printed(df: DataFrame, name: str) -> DataFrame:
        m = df.filter(F.col(member).isNotNull()).groupBy(group, member).agg(F.lit(1))
        half = lambda seed: F.sum((F.xxhash64(member, F.lit(seed)) / F.lit(2.0**20)).cast("long"))
        return m.groupBy(F.col(group).alias(name)).agg(F.count(F.lit(1)).alias("n"), half(1).alias("h1"), half(2).alias("h2"))

    met = cut(printed(left, "left_group").join(printed(right, "right_group"), ["n", "h1", "h2"]).select("left_group", "right_group", "n"))
    a = left.select(F.col(group).alias("left_group"), F.col(member).alias("m")).distinct().join(met, "left_group")
    b = right.select(F.col(group).alias("right_group"), F.col(member).alias("m")).distinct()
    both = a.join(b, ["right_group", "m"]).groupBy("left_group", "right_group", "n").agg(F.count(F.lit(1)).alias("k"))
    return both.filter("k = n").select("left_group", "right_group")


def merged(members: DataFrame, added: DataFrame) -> DataFrame:
    """(cluster_id, id, new): the union of member lists (cluster_id, id), one row a member, ``new`` where only ``added`` has it."""
    both = members.select("cluster_id", "id", F.lit(0).alias("o")).unionByName(added.select("cluster_id", "id", F.lit(1).alias("o")))
    return both.groupBy("cluster_id", "id").agg((F.min("o") == 1).alias("new"))


def flow(groups: DataFrame, members: DataFrame, clusters: DataFrame, valid: DataFrame, dim: int, days: int = 7) -> DataFrame:
    """(grp, n, action, cluster_id) of proposed ``groups`` (grp long, id, v): ``small`` below four events, ``skip`` where a cluster has the very same events,
    ``merge`` into the newest similar cluster, else ``create`` if ``valid`` (grp) has it, else ``reject``. ``members`` (cluster_id, id) and ``clusters`` as in ``similar_existing``."""
    sizes = cut(groups.groupBy("grp").agg(F.countDistinct("id").alias("n")))
    large = groups.join(bounded(sizes.filter(F.col("n") >= LEAST).select("grp")), "grp", "left_semi")
    same = equal_sets(large.select("grp", "id"), members.select(F.col("cluster_id").alias("grp"), "id"), "grp", "id")
    same = same.groupBy(F.col("left_group").alias("grp")).agg(F.min("right_group").alias("same"))
    like = similar_existing(V.centroid_vectors(large.filter(V.usable(F.col("v"), dim)), "grp", "v"), clusters, dim, days=days).select("grp", F.col("cluster_id").alias("like"))
    out = sizes.join(same, "grp", "left").join(like, "grp", "left").join(valid.select("grp", F.lit(True).alias("ok")).distinct(), "grp", "left")
    action = F.when(F.col("n") < LEAST, "small").when(F.col("same").isNotNull(), "skip").when(F.col("like").isNotNull(), "merge").when(F.col("ok"), "create").otherwise("reject")
    into = F.when(F.col("n") >= LEAST, F.coalesce("same", "like"))
    return out.select("grp", "n", action.alias("action"), into.alias("cluster_id"))


def voted(near: DataFrame, members: DataFrame, floor: float = SIMILAR) -> DataFrame:
    """(id, cluster_id, score): the cluster that the neighbours (query, id, cosine) vote for.

    A cluster's vote is the mean cosine of its members among them plus ln(n + 1) / 10, to 9 digits; the best counts from ``floor`` on, ties to the smaller id.
    """
    votes = near.join(members.select("id", "cluster_id"), "id").groupBy("query", "cluster_id").agg(F.round(F.avg("cosine") + F.log(F.count(F.lit(1)) + 1) / 10, 9).alias("s"))
    best = votes.groupBy(F.col("query").alias("id")).agg(F.max(F.struct("s", (-F.col("cluster_id")).alias("c"))).alias("m"))
    return best.filter(F.col("m.s") >= floor).select("id", (-F.col("m.c")).alias("cluster_id"), F.col("m.s").alias("score"))


def assigned(events: DataFrame, active: DataFrame, orphans: DataFrame, dim: int, looked_at: int = 20, among: int = 50) -> DataFrame:
    """(id, action, cluster_id, member) of a batch of ``events`` (id, v, at): one row an event, and one a member of each cluster founded.

    ``merge``: the cluster its ``looked_at`` nearest ``active`` vectors (id, v, cluster_id) vote for. ``create``: of its ``among`` nearest ``orphans``
    (id, v, at) the first three of at least 0.7, no more than 24 hours older, found a cluster with it; cluster_id is then the founder's id and there is a row for each of the
    four members. Else ``orphan``, as for events without a usable vector. All events of a batch see the state at its start; where founders claim a common
    member, the least founder goes first and the others stay orphans until the next batch.
    """
    asked = events.select("id", "v")
    joined = cut(voted(V.search(asked, active.select("id", "v"), dim, looked_at), active))
    rest = cut(events.join(bounded(joined.select("id")), "id", "left_anti"))
    near = V.search(rest.select("id", "v"), orphans.select("id", "v"), dim, among, FORM)
    at = rest.select(F.col("id").alias("query"), F.col("at").alias("asked"))
    near = near.join(orphans.select("id", "at"), "id").join(at, "query").filter(F.expr("at >= asked - INTERVAL 24 HOURS"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    three = cut(near.withColumn("r", place).filter(F.col("r") <= OTHERS).select(F.col("query").alias("founder"), F.col("id").alias("member")))
    full = three.groupBy("founder").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == OTHERS).select("founder")
    claims = three.join(full, "founder", "left_semi").unionByName(full.select("founder", F.col("founder").alias("member")))
    first = claims.groupBy("member").agg(F.min("founder").alias("least"))
    lost = claims.join(first, "member").filter("founder <> least").select("founder").distinct()
    made = cut(claims.join(lost, "founder", "left_anti"))
    one = lambda df, action, cluster, member: df.select("id", F.lit(action).alias("action"), cluster.cast("long").alias("cluster_id"), member.cast("long").alias("member"))
    out = one(joined, "merge", F.col("cluster_id"), F.col("id"))
    out = out.unionByName(one(made.withColumn("id", F.col("founder")), "create", F.col("founder"), F.col("member")))
    alone = rest.join(made.select(F.col("founder").alias("id")).distinct(), "id", "left_anti")
    return out.unionByName(one(alone, "orphan", F.lit(None), F.lit(None)))


def by_cluster(rows: DataFrame, key: str) -> DataFrame:
    """(cluster_id, text): how often each value of ``key`` occurs in a cluster, as ``value:count`` by value; nulls and blanks left out. Counted before anything meets by cluster."""
    n = rows.filter(F.trim(key) != "").groupBy("cluster_id", F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "n"))), lambda s: F.concat(s["k"], F.lit(":"), s["n"].cast("string")))
    return n.groupBy("cluster_id").agg(F.array_join(listed, ",").alias("text"))

