"""Grouping vectors by hierarchical density clustering over a mutual-reachability graph."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.vectors import Routed, forest_edges, nearest
from siftspark.operators.skew import join_by_load
from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut, drop


def reachability_edges(routed: Routed, dim: int, min_samples: int, floor: float) -> DataFrame:
    """(a, b, w), a < b: a sparse graph whose maximum spanning forest is that of mutual reachability at ``floor`` and above.

    The core similarity of a vector is the cosine with its ``min_samples - 1``-th nearest other one, and
    the weight of a pair is the least of its cosine and both core similarities. With ``min_samples`` 2 a
    core similarity is never below a pair's own cosine, so the weight is the cosine and no search for
    core similarities is made. Vectors whose core similarity is below ``floor`` are in no edge.
    """
    if min_samples <= 2:
        return forest_edges(routed, dim, floor)
    k = min_samples - 1
    around = nearest(routed, dim, k, floor)
    core = around.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("core")).filter(F.col("n") >= k)
    return forest_edges(routed, dim, floor, cut(core.select("id", "core")))


def spanning_tree(edges: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(tree, labels): the maximum spanning forest of ``edges`` (a, b, w), and (id, label) of every vertex in an edge.

    Distributed Borůvka. In a round every component picks its best outgoing edge (greatest w, then least a, b),
    the picks are hooked to trees with the least id of a mutual pair as root, pointer jumping flattens
    them, and the edges are relabelled; those inside a component are gone. A component at least doubles
    in a round, so the rounds are logarithmic. A label is some vertex of its component. No edge gives two empty tables.
    """
    live = cut(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    labels = cut(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("label")))
    picked: list[DataFrame] = []
    for _ in range(most_rounds):
        if not live.head(1):
            break
        ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("d")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("d"))))
        best = live.select("a", "b", "w", ends.alias("e")).groupBy("e.c").agg(F.min(F.struct((-F.col("w")).alias("o"), "a", "b", F.col("e.d").alias("d"))).alias("m"))
        best = cut(best.select("c", F.col("m.d").alias("d"), F.col("m.a").alias("a"), F.col("m.b").alias("b"), (-F.col("m.o")).alias("w")))
        picked.append(best.select("a", "b", "w").distinct())
        back = best.select(F.col("c").alias("d"), F.col("d").alias("back"))
        up = best.select("c", "d").join(back, "d", "left")
        up = up.select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("p"))
        up = flattened(up)
        renamed = live.join(up.select(F.col("c").alias("ca"), F.col("p").alias("pa")), "ca").join(up.select(F.col("c").alias("cb"), F.col("p").alias("pb")), "cb")
        after = cut(renamed.filter("pa <> pb").select("a", "b", "w", F.col("pa").alias("ca"), F.col("pb").alias("cb")))
        new = cut(labels.join(up, F.col("label") == F.col("c"), "left").select("id", F.coalesce("p", "label").alias("label")))
        for old in (live, labels, up):
            drop(old)
        live, labels = after, new
    else:
        raise RuntimeError("Borůvka did not end")
    tree = picked[0] if picked else live.select("a", "b", "w")
    for more in picked[1:]:
        tree = tree.unionByName(more)
    return tree, labels


def flattened(up: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(c, p) of trees by pointer jumping: every p becomes the root. Roots point to themselves."""
    up = cut(up)
    for _ in range(most_rounds):
        grand = up.select(F.col("c").alias("p"), F.col("p").alias("g"))
        jumped = cut(up.join(grand, "p", "left").select("c", F.coalesce("g", "p").alias("p"), (F.coalesce("g", "p") != F.col("p")).alias("moved")))
        drop(up)
        up = jumped.select("c", "p")
        if not jumped.filter("moved").head(1):
            return up
    raise RuntimeError("pointer jumping did not end")


def with_copies(labels: DataFrame, routed: Routed, lone: bool = True) -> DataFrame:
    """(id, label) of all vectors in a group: the representatives in ``labels`` and their exact copies; with ``lone`` also copies whose representative has no other link."""
    if not routed.copies.head(1):
        return labels
    classes = routed.copies.select("rep", F.col("id").alias("copy"))
    every = labels
    if lone:
        alone = classes.select(F.col("rep").alias("id")).distinct().join(labels, "id", "left_anti")
        every = labels.unionByName(alone.select("id", F.col("id").alias("label")))
    return every.join(bounded(classes), F.col("id") == F.col("rep"), "left").select(F.coalesce("copy", "id").alias("id"), "label")


def pairs_of_groups(members: DataFrame, group: str, key: str, a: str, b: str) -> DataFrame:
    """All pairs a < b of the members of each group; as many rows as the groups have pairs. Large groups are cut into shards, each of which meets all members."""
    members = cut(members.select(F.col(group).alias("__g"), F.col(key).alias(a)))
    pairs = join_by_load(members, members.withColumnRenamed(a, b), "__g", a)
    return pairs.filter(F.col(a) < F.col(b)).select(a, b)


#: Vertices of a component from which a warning says how much the one task that builds its hierarchy holds; results do not depend on it.
COMPONENT = 200_000


def _flat(part) -> list[int]:
    """The vertices of a part, which is a vertex or two parts."""
    out, rest = [], [part]
    while rest:
        x = rest.pop()
        if isinstance(x, tuple):
            rest += x
        else:
            out.append(x)
    return out


def condensed(ids: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, floor: float, least: int, most: int, tops: list | None = None) -> list[tuple]:
    """Selected clusters of the components of a forest: (members, stability, exemplars). ``tops`` gets the members of the top of every hierarchy, the cluster that ends at ``floor``.

    Edges join in order of falling similarity. A part of at least ``least`` members is a cluster; where two clusters
    join, both end and a new one begins; a smaller part just adds its members, each with the level at which it came in. The
    stability of a cluster is the sum over its members of (level of coming in or of the split into child clusters, minus the level at which the cluster
    ends); clusters are selected bottom up, a parent replacing its children when it is at least as stable as they are together. Exemplars are
    the ``most`` members with the highest level, then smallest id. ``weight`` counts exact copies behind a vertex.
    """
    n = len(ids)
    root = list(range(n))
    parts: list = list(range(n))
    count = [1] * n
    size = weight.astype(np.int64).tolist()
    level = np.where(weight >= least, 1.0, -1.0)
    # per root: None, or [sum of levels, best stability below, chosen below: None or (chosen, chosen, None or (part, stability))]
    state: list[list | None] = [[float(s), 0.0, None] if s >= least else None for s in size]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def close(r, at):
        total, below, chosen = state[r]
        own = total - at * size[r]
        return (own, (None, None, (parts[r], own))) if own >= below else (below, chosen)

    for e in np.lexsort((b, a, -w)).tolist():
        p, q, at = find(a[e]), find(b[e]), float(w[e])
        if p == q:
            continue
        if count[p] < count[q]:
            p, q = q, p
        sp, sq = state[p], state[q]
        if sp is not None and sq is not None:
            best_p, best_q = close(p, at), close(q, at)
            new = [at * (size[p] + size[q]), best_p[0] + best_q[0], (best_p[1], best_q[1], None)]
        elif sp is not None or sq is not None:
            new = sp if sp is not None else sq
            small = q if sp is not None else p
            new[0] += at * size[small]
            level[_flat(parts[small])] = at
        elif size[p] + size[q] >= least:
            new = [at * (size[p] + size[q]), 0.0, None]
            level[_flat((parts[p], parts[q]))] = at
        else:
            new = None
        root[q] = p
        parts[p] = (parts[p], parts[q])
        parts[q] = None
        count[p] += count[q]
        size[p] += size[q]
        state[p], state[q] = new, None
    out = []
    for r in range(n):
        if root[r] == r and state[r] is not None:
            if tops is not None:
                tops.append(np.sort(_flat(parts[r])))
            rest = [close(r, floor)[1]]
            while rest:
                chosen = rest.pop()
                if chosen is None:
                    continue
                if chosen[2] is None:
                    rest += chosen[:2]
                    continue
                part, own = chosen[2]
                m = np.sort(_flat(part))
                typical = m[np.lexsort((ids[m], -level[m]))][:most]
                out.append((m, own, typical))
    return out


#: Vertices of the components that one task takes together; a component is never divided.
TOGETHER = 20_000


def hierarchies(routed: Routed, dim: int, min_samples: int, floor: float, least: int, most: int) -> DataFrame:
    """(id, top, cluster_id, stability, place) of the representatives in a hierarchy: the least member of the top of its condensed hierarchy,
    that of its selected cluster, the cluster's stability, and its place among the exemplars; the last three null for what is noise below the top.

    The mutual-reachability graph gives a spanning forest by distributed Borůvka, and each tree of it a condensed hierarchy,
    whole, in one task, whatever its size.
    """
    found = reachability_edges(routed, dim, min_samples, floor)
    edges = cut(found)
    drop(found)
    tree, labels = spanning_tree(edges)
    tree = cut(tree)
    if routed.copies.head(1):
        # copies without another link make a hierarchy of their own
        alone = routed.copies.select(F.col("rep").alias("id")).distinct().join(labels, "id", "left_anti")
        labels = labels.unionByName(alone.select("id", F.col("id").alias("label")))
    whole = cut(labels.select("id", "label"))
    total = whole.count()
    largest = whole.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    if largest > COMPONENT:
        warnings.warn(f"one task builds the hierarchy of a component of {largest} vertices", stacklevel=2)
    task = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-total // TOGETHER)))).alias("task")
    copies = routed.copies.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    vertices = whole.join(copies, "id", "left").select(task, "id", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"))
    ends = tree.join(whole.withColumnRenamed("id", "a"), "a")
    ends = ends.select(task, F.col("a").alias("id"), F.lit(None).cast("long").alias("n"), "b", "w")

    def some(table: pa.Table) -> pa.Table:
        node = np.asarray(pa.compute.is_null(table.column("b")))
        ids = np.asarray(table.column("id"))
        v = ids[node]
        order = np.argsort(v)
        v = v[order]
        n = np.asarray(table.column("n").filter(pa.array(node)))[order]
        b = np.asarray(table.column("b").filter(pa.array(~node)))
        w = np.asarray(table.column("w").filter(pa.array(~node)))
        top, group, stability, place = (np.full(len(v), x) for x in (-1, -1, np.nan, -1))
        tops: list[np.ndarray] = []
        for members, own, typical in condensed(v, n, np.searchsorted(v, ids[~node]), np.searchsorted(v, b), w, floor, least, most, tops):
            group[members], stability[members] = members.min(), own
            place[typical] = np.arange(1, len(typical) + 1)
        for members in tops:
            top[members] = members.min()
        kept, chosen = top >= 0, group >= 0
        values = {"id": pa.array(v), "top": pa.array(v[top]), "cluster_id": pa.array(v[group], mask=~chosen), "stability": pa.array(stability, mask=~chosen), "place": pa.array(place, mask=place < 0)}
        return pa.table(values).filter(pa.array(kept))

    return vertices.unionByName(ends).groupBy("task").applyInArrow(some, "id long, top long, cluster_id long, stability double, place long")


def clusters(routed: Routed, dim: int, min_samples: int, floor: float, least: int = 5, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): clusters (cluster_id, size, stability, exemplars), members (id, cluster_id).

    A cluster's id is its least member's. Vectors outside every selected cluster are noise and in neither. Exact copies follow
    their representative and count in sizes.
    """
    found = cut(hierarchies(routed, dim, min_samples, floor, least, most).filter("cluster_id IS NOT NULL"))
    members = with_copies(found.select("id", F.col("cluster_id").alias("label")), routed, lone=False).select("id", F.col("label").alias("cluster_id"))
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    typical = F.transform(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "id")))), lambda x: x["id"])
    about = found.groupBy("cluster_id").agg(F.max("stability").alias("stability"), typical.alias("exemplars"))
    return sizes.join(about, "cluster_id"), members


def tops(routed: Routed, dim: int, floor: float) -> DataFrame:
    """(id, label) of all vectors in the top of a condensed hierarchy with clusters of two from ``floor`` on; copies follow their representative."""
    found = hierarchies(routed, dim, 2, floor, 2, 1).select("id", F.col("top").alias("label"))
    return with_copies(cut(found), routed, lone=False)
