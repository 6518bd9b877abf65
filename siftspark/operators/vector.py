"""Exact vector search of a stated query set against all rows, centroids and cohesion."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.plans.scratch import cut

BLOCK = 20_000  #: query vectors that are broadcast: 10 MB at 64 numbers; more meet the rows in a grid of blocks


def usable(vector, dim: int):
    """Whether an array column is a vector of ``dim`` numbers, none null, NaN or infinite, not all zero."""
    return (
        vector.isNotNull()
        & (F.size(vector) == dim)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def _unit(column, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _met(queries: DataFrame, rows: DataFrame, dim: int, kernel, schema: str, block: int) -> DataFrame:
    """What ``kernel(query ids, unit queries, a record batch (id, v, ...))`` yields for every query and every row, in one pass over the rows.

    Up to ``block`` queries are broadcast. More are cut into blocks and so are the rows, and every pair of blocks meets in a group of
    its own: one shuffle, in which a row travels once for each block of queries and a query once for each block of rows.
    """
    spark = rows.sparkSession
    ok = usable(F.col("v"), dim)
    queries = queries.filter(ok).select(F.col("id").cast("long").alias("id"), "v")
    rows = rows.filter(ok).withColumn("id", F.col("id").cast("long"))
    rows = rows.select("id", "v", *[c for c in rows.columns if c not in ("id", "v")])
    held = queries.limit(block + 1).toArrow()
    if held.num_rows <= block:
        none = not held.num_rows
        ids = np.empty(0, np.int64) if none else np.asarray(held.column("id").combine_chunks())
        shared = spark.sparkContext.broadcast((ids, np.empty((0, dim)) if none else _unit(held.column("v").combine_chunks(), dim)))

        def with_all(batches):
            qid, q = shared.value
            for batch in batches:
                if batch.num_rows and len(qid):
                    yield from kernel(qid, q, batch)

        return rows.mapInArrow(with_all, schema)
    queries, rows = cut(queries), cut(rows)
    down, across = -(-queries.count() // block), max(1, -(-rows.count() // (4 * block)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("x", part(down)).withColumn("y", every(across))
    right = rows.withColumn("y", part(across)).withColumn("x", every(down))

    def pair(asked: pa.Table, table: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and table.num_rows:
            qid, q = np.asarray(asked.column("id").combine_chunks()), _unit(asked.column("v").combine_chunks(), dim)
            for batch in table.drop_columns(["x", "y"]).combine_chunks().to_batches(max_chunksize=10_000):
                found += kernel(qid, q, batch)
        return pa.Table.from_batches(found) if found else kernel.nothing

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(pair, schema)


class _Nearest:
    """The k rows of highest cosine a query among a batch."""

    nothing = pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})

    def __init__(self, dim: int, k: int, floor: float):
        self.dim, self.k, self.floor = dim, k, floor

    def __call__(self, qid, q, batch):
        rid, x, k = np.asarray(batch.column(0)), _unit(batch.column(1), self.dim), self.k
        for s in range(0, len(qid), 500):
            cos = (q[s : s + 500] @ x.T).round(12)
            cos[qid[s : s + 500, None] == rid[None, :]] = -2
            least = np.full(len(cos), max(self.floor, -1.0))
            if cos.shape[1] > k:
                # ties with the k-th best stay in; the order below decides among them
                least = np.maximum(least, np.partition(cos, -k, axis=1)[:, -k])
            a, b = np.nonzero(cos >= least[:, None])
            v = cos[a, b]
            order = np.lexsort((rid[b], -v, a))
            a, b, v = a[order], b[order], v[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            yield pa.RecordBatch.from_arrays([pa.array(qid[s : s + 500][a[keep]]), pa.array(rid[b[keep]]), pa.array(v[keep])], names=["query", "id", "cosine"])


class _First:
    """Of the rows of at least a cosine the one of least ``rank`` a query among a batch."""

    nothing = pa.table({"query": pa.array([], pa.int64()), "rank": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})

    def __init__(self, dim: int, floor: float):
        self.dim, self.floor = dim, floor

    def __call__(self, qid, q, batch):
        rid, x, rank = np.asarray(batch.column(0)), _unit(batch.column(1), self.dim), np.asarray(batch.column(2))
        order = np.argsort(rank, kind="stable")
        rid, x, rank = rid[order], x[order], rank[order]
        for s in range(0, len(qid), 500):
            cos = (q[s : s + 500] @ x.T).round(12)
            good = (cos >= self.floor) & (qid[s : s + 500, None] != rid[None, :])
            a = np.flatnonzero(good.any(axis=1))
            b = good[a].argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(qid[s : s + 500][a]), pa.array(rank[b]), pa.array(rid[b]), pa.array(cos[a, b])], names=["query", "rank", "id", "cosine"])


def search(queries: DataFrame, rows: DataFrame, dim: int, k: int, floor: float = -1.0, block: int = BLOCK) -> DataFrame:
    """(query, id, cosine): for each of ``queries`` (id, v) the k rows (id, v) of highest cosine, then smaller id, itself left out.

    Exact. Every task keeps its own best k a query, and the rest is a top-k by query. Vectors that are not ``usable`` take no part.
    """
    out = _met(queries, rows.select("id", "v"), dim, _Nearest(dim, k, floor), "query long, id long, cosine double", block)
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return out.withColumn("r", r).filter(F.col("r") <= k).drop("r")


def first_similar(queries: DataFrame, rows: DataFrame, dim: int, floor: float, block: int = BLOCK) -> DataFrame:
    """(query, id, cosine): for each of ``queries`` (id, v) the row (id, v, rank) of least rank among those of at least ``floor``, itself left out. Ranks are unique."""
    out = _met(queries, rows.select("id", "v", "rank"), dim, _First(dim, floor), "query long, rank long, id long, cosine double", block)
    best = out.groupBy("query").agg(F.min(F.struct("rank", "id", "cosine")).alias("m"))
    return best.select("query", "m.id", "m.cosine")


PAIRS = 200_000  #: pairs that a batch of results holds, about


def _placed(rows: DataFrame, group: str, tasks: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(queries, members) with ``__task`` and the part of the group: heavy groups are cut into parts of members and of queries, which all meet.

    A group is heavy from a quarter of a task's fair share of pairs on; only those reach the driver. Parts go to the least loaded task, largest first.
    """
    load = cut(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).filter("q > 0"))
    pairs = F.col("n").cast("double") * F.col("q")
    unit = max(1.0, (load.agg(F.sum(pairs)).head()[0] or 0) / tasks / 4)
    heavy = load.filter((pairs > unit) | (F.col("q") > block)).orderBy(F.desc("n"), group).collect()
    free, spots = [(0.0, t) for t in range(tasks)], []
    for r in heavy:
        y = -(-r["q"] // block)
        x = max(1, min(tasks, math.ceil(r["n"] * r["q"] / unit / y)))
        for i in range(x):
            for j in range(y):
                used, t = heapq.heappop(free)
                spots.append((r[group], x, y, i, j, t))
                heapq.heappush(free, (used + r["n"] * r["q"] / x / y, t))
    kind = rows.schema[group].dataType.simpleString()
    spot = F.broadcast(rows.sparkSession.createDataFrame(spots, f"__g {kind}, __x int, __y int, __i int, __j int, __t int"))
    light = F.pmod(F.xxhash64(group), F.lit(tasks)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    whole = rows.join(load.select(F.col(group).alias("__g")), F.col(group) == F.col("__g"), "left_semi")
    put = lambda df, on: df.join(spot, (F.col(group) == F.col("__g")) & on, "left").select(F.coalesce("__t", light).alias("__task"), F.col(group).alias("__group"), F.coalesce("__i", F.lit(0)).alias("__i"), F.coalesce("__j", F.lit(0)).alias("__j"), "id", "v")
    return put(whole.filter("asks"), part("__y") == F.col("__j")), put(whole, part("__x") == F.col("__i"))


def pairs_in_groups(rows: DataFrame, group: str, dim: int, tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine): every row of ``rows`` (group, id, v, asks) that asks with all other rows of its group; cosines in double, rounded to 6 digits, halves away from 0.

    ``v`` must be ``usable``; null groups take no part. Queries of a part come first in its task, at most ``block`` or so of them are held, and the members stream past.
    """
    tasks = tasks or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(rows.filter(F.col(group).isNotNull()).select(group, "id", "v", "asks"))
    queries, members = _placed(rows, group, tasks, block)
    both = queries.withColumn("__side", F.lit(0)).unionByName(members.withColumn("__side", F.lit(1)))
    key = ["__group", "__i", "__j"]
    both = both.repartitionById(tasks, F.col("__task")).sortWithinPartitions(*key, "__side").select(*key, "__side", "id", "v")

    def meet(batches):
        now, asked, units, q, small, held = None, [], [], None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            ids, x = np.asarray(batch.column(4)), _unit(batch.column(5), dim)
            for s, e in zip([0, *edges], [*edges, len(keys)]):
                if keys[s][:3] != now:
                    now, asked, units, q = keys[s][:3], [], [], None
                if keys[s][3] == 0:
                    asked.append(ids[s:e])
                    units.append(x[s:e])
                    continue
                if not asked:
                    continue
                if q is None:
                    q, qid = np.concatenate(units), np.concatenate(asked)
                step = max(1, PAIRS // (e - s))
                for i in range(0, len(qid), step):
                    cos = (q[i : i + step] @ x[s:e].T).ravel()
                    cos = np.copysign(np.floor(np.abs(cos) * 1e6 + 0.5) / 1e6, cos)
                    a, b = np.repeat(qid[i : i + step], e - s), np.tile(ids[s:e], len(qid[i : i + step]))
                    keep = a != b
                    if not keep.all():
                        a, b, cos = a[keep], b[keep], cos[keep]
                    small.append((a, b, cos))
                    held += len(a)
                    if held >= PAIRS // 2:
                        yield _rows(small)
                        small, held = [], 0
        if small:
            yield _rows(small)

    return both.mapInArrow(meet, "a long, b long, cosine double")


def _rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["a", "b", "cosine"])


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, d, mean): the element-wise mean per group, one row a dimension; partial sums travel, not vectors."""
    return rows.select(group, F.posexplode(vector).alias("d", "x")).groupBy(group, "d").agg(F.avg("x").alias("mean"))


def centroid_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, v): the centroids as arrays; a centroid is one row of as many numbers as a vector has."""
    m = centroids(rows, group, vector).groupBy(group)
    return m.agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "mean"))), lambda s: s["mean"]).alias("v"))
