"""Similarity search over all vectors of a table: coarse p-stable cells over the cluster, fine hashing inside a cell.

A coarse hash is the side of a vector along a 2-stable direction, from the median, so that cells hold even shares. A vector
asks in its own cell, and visits every cell whose estimated success is high enough: the squared distances to the bounds that
lead there add up to ``MARGIN`` squared at most. A pair is found if one of both visits the other's own cell and, inside it, multiprobe hashing brings
them together. One rule holds at every size; the number of hashes follows the number of rows. Exact copies are folded to
one representative (the smallest id) before anything is routed, so a group of copies never makes a
bucket hot. Cells that stay too large (dense groups, which no hash splits) are compared in blocks: each shard of the own rows
of such a cell meets each shard of its visitors in a block of its own, so no row is dropped and no further pair lost. Cells are
taken in waves, each of which sends ``WAVE`` times the rows at most, and only once the rows where there are enough cells to keep all
tasks busy, so what lies on disk at once does not grow with the number of visits. A wave takes cells that agree in their first
hashes, so a row is followed only to these.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.hashing import Hashing, candidate_blocks, exact_cosines, projections
from siftspark.operators.current import current_wide_rows
from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut, drop

SHARE = 40_000  #: mean rows of a cell, without the visitors from neighbouring cells
CELL_ROWS = 80_000  #: own rows from which a cell is compared in blocks of shards, as from twice as many with visitors: 61 MB of vectors of 64 numbers a block at most
MARGIN = 0.7  #: how far a vector looks across the bounds of its cell; in this unit two unit vectors of cosine c are sqrt(2 - 2c) * a standard normal number apart along a direction
WAVE = 2  #: rows sent at once for each row of the table, at most; one where every wave still has ``BUSY`` blocks for each task that runs at once
BUSY = 2
SAMPLE = 20_000  #: vectors that the medians are taken from, about; every row is indexed
_FOLD = 2_000_000  #: candidate pairs held in a task before they are reduced
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows as float32, and a mask of these: right length, no null or NaN, finite, not all zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(col).fill_null(-1))
    right = lengths == dim
    flat = col.filter(pa.array(right)).flatten()
    with np.errstate(over="ignore"):
        x = np.asarray(flat.cast(pa.float64()).fill_null(math.nan)).reshape(-1, dim).astype(np.float32)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    mask = right.copy()
    mask[right] = ok
    return x[ok], mask


def _units(x: np.ndarray) -> np.ndarray:
    """The rows scaled to length 1, for hashing and for single-precision products."""
    wide = x.astype(np.float64)
    return (wide / np.sqrt((wide * wide).sum(axis=1))[:, None]).astype(np.float32)


def usable_vectors(df: DataFrame, key: str, vector: str, at: str, dim: int) -> DataFrame:
    """(id, v): the current row of each key, its vector as float32 bytes.

    Null keys, and vectors that are null, of another length, all zero, or hold a null, NaN or
    infinity are left out. Empty in, empty out; other columns are ignored.
    """
    return packed(current_wide_rows(df, key, at, [vector]), key, vector, dim)


def packed(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v) of all usable vectors of a table, as float32 bytes."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def pack(batches):
        for batch in batches:
            x, mask = _matrix(batch.column(1), dim)
            ids = batch.column(0).filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays([ids, _binary(x)], names=["id", "v"])

    return rows.mapInArrow(pack, "id long, v binary")


def _binary(x: np.ndarray) -> pa.Array:
    n, width = len(x), x.shape[1] * 4
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1])
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(x))])


def _unbinary(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.empty((0, dim), np.float32)
    first = np.frombuffer(col.buffers()[1], np.int64)[col.offset]
    return np.frombuffer(col.buffers()[2], np.float32, len(col) * dim, first).reshape(-1, dim)


@dataclass
class Routing:
    """How vectors travel: directions of the coarse hashes (one in each row) and their bounds; shards (own rows, all rows) of the cells that are too large; the wave and task of every cell or block."""

    directions: np.ndarray
    middle: np.ndarray
    shards: dict[int, tuple[int, int]] = field(default_factory=dict)
    tasks: dict[int, tuple[int, int]] = field(default_factory=dict)

    def visits(self, x: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own) of unit vectors: first the own cells of all, then all whose crossed bounds are within the margin together.

        Of the cells ``among`` only, if given; paths that lead to none of them are left hash by hash.
        """
        p = x @ self.directions.T - self.middle
        rows, cost, own = np.arange(len(x)), np.zeros(len(x), np.float32), np.ones(len(x), bool)
        cells = (p > 0) @ (np.int64(1) << np.arange(p.shape[1], dtype=np.int64))
        for i in range(p.shape[1]):
            c = cost + p[rows, i] ** 2
            m = c <= MARGIN**2
            rows, cells, cost = np.concatenate([rows, rows[m]]), np.concatenate([cells, cells[m] ^ np.int64(1 << i)]), np.concatenate([cost, c[m]])
            own = np.concatenate([own, np.zeros(m.sum(), bool)])
            if among is not None:
                # the hashes up to this one are settled
                first = np.int64((2 << i) - 1)
                m = np.isin(cells & first, np.unique(among & first))
                rows, cells, cost, own = rows[m], cells[m], cost[m], own[m]
        return rows, cells, own

    def blocks(self, rows: np.ndarray, cells: np.ndarray, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, asks) of visits: a cell as it is, or the blocks of pairs of shards that the row takes part in."""
        if not self.shards:
            return rows, cells, own
        m = np.isin(cells, np.fromiter(self.shards, np.int64))
        out = [(rows[~m], cells[~m], own[~m])]
        for cell in np.unique(cells[m]).tolist():
            asking, among = self.shards[cell]
            here = cells == cell
            r, o = rows[here], own[here]
            with np.errstate(over="ignore"):
                s = (ids[r].astype(np.uint64) * _K1 >> np.uint64(33)).astype(np.int64)
            i, j = s % asking, s // asking % among
            for k in range(among):
                out.append((r[o], block_number(cell, i[o] * among + k), o[o]))
            for k in range(asking):
                rest = ~(o & (i == k))
                out.append((r[rest], block_number(cell, k * among + j[rest]), np.zeros(rest.sum(), bool)))
        return tuple(np.concatenate(c) for c in zip(*out))


def block_number(cell: int, pair):
    """The number of a block of a cell; negative, so that it is none of a cell."""
    with np.errstate(over="ignore"):
        mixed = np.uint64(cell + 1) * _K2 ^ (np.asarray(pair).astype(np.uint64) + np.uint64(1)) * _K1
    return (mixed | np.uint64(1 << 63)).astype(np.int64)


def fitted(sample: DataFrame, dim: int, n: int, share: int = SHARE) -> Routing:
    """Coarse hashes for n vectors: as many as leave ``share`` rows in a mean cell. The bounds are medians of a sample of bounded size."""
    hashes = max(0, math.ceil(math.log2(max(1, n) / share)))
    if not hashes:
        return Routing(np.empty((0, dim), np.float32), np.empty(0, np.float32))
    directions, _ = projections(dim, 1000, hashes, 1.0, 7)
    x = _unbinary(sample.select("v").limit(2 * SAMPLE).toArrow().column("v"), dim)
    return Routing(directions, np.median(_units(x) @ directions.T, axis=0).astype(np.float32) if len(x) else np.zeros(hashes, np.float32))


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``SAMPLE`` of the n rows, by a hash of their key."""
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < math.ceil(1_000_000 * min(1.0, SAMPLE / max(1, n))))


@dataclass
class Routed:
    """``vectors`` (id, v) of the representatives and how they travel, in how many waves and tasks; ``copies`` (id, rep) of all exact copies, representatives too."""

    vectors: DataFrame
    copies: DataFrame
    routing: Routing
    waves: int
    tasks: int


def route(vectors: DataFrame, dim: int, n: int, share: int = SHARE, cell_rows: int = CELL_ROWS, sample: DataFrame | None = None) -> Routed:
    """Fold exact copies and send every representative to its cells. ``n`` (about the number of rows) sets the coarse hashes.

    ``sample`` (v), for the bounds, is taken of the vectors if not given. Cells of more than ``cell_rows`` rows are taken apart into blocks.
    Cells and blocks are packed onto tasks by their rows, the largest first, so no two large ones share one by chance.
    """
    vectors = cut(vectors)
    routing = fitted(sampled(vectors, "id", n) if sample is None else sample, dim, n, share)

    def keys(batches):
        mix = np.random.default_rng(11).integers(1, 2**63, (2, dim), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            x = _unbinary(batch.column(1), dim)
            if not len(x):
                continue
            bits = (x + np.float32(0)).view(np.uint32).astype(np.uint64)
            bits ^= bits << np.uint64(29)
            with np.errstate(over="ignore"):
                h = [(bits * m).sum(axis=1) for m in mix]
                h = [((a ^ (a >> np.uint64(31))) * _K2).astype(np.int64) for a in h]
            rows, cells, _ = routing.visits(_units(x))
            order = np.argsort(rows, kind="stable")
            counts = np.bincount(rows, minlength=len(x))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(cells[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[0]), pa.array(h[1]), lists], names=["id", "h1", "h2", "cells"])

    narrow = cut(vectors.mapInArrow(keys, "id long, h1 long, h2 long, cells array<long>"))
    groups = narrow.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = cut(groups)
    copies = cut(narrow.join(bounded(groups), ["h1", "h2"]).select("id", "rep"))
    again = bounded(copies.filter("id <> rep").select(F.col("id").alias("__id")))
    reps = lambda df: df.join(again, F.col("id") == F.col("__id"), "left_anti")

    # one row a cell: about n / share of them
    own = F.count_if(F.col("pos") == 0).alias("own")
    sizes = {r["cell"]: (r["own"], r["n"]) for r in reps(narrow).select(F.posexplode("cells").alias("pos", "cell")).groupBy("cell").agg(own, F.count(F.lit(1)).alias("n")).filter("own > 0").collect()}
    drop(narrow)
    kept = cut(reps(vectors))
    drop(vectors)
    sent: dict[int, float] = {}
    loads: dict[int, float] = {}
    # cells that agree in their first hashes are neighbours in this order
    for cell, (own_, n_) in sorted(sizes.items(), key=lambda c: f"{c[0]:063b}"[::-1]):
        asking, among = math.ceil(own_ / cell_rows), math.ceil(n_ / (2 * cell_rows))
        blocks = [cell]
        if asking * among > 1:
            routing.shards[cell] = asking, among
            blocks = [int(block_number(cell, i)) for i in range(asking * among)]
        for block in blocks:
            sent[block] = n_ / among + own_ / asking * (len(blocks) > 1)
            loads[block] = sent[block] + 4 * own_ / asking
    spark = kept.sparkSession
    at_once = spark.sparkContext.defaultParallelism
    total, rows = sum(sent.values()), max(n, share)
    waves = max(1, math.ceil(total / (WAVE * rows)), min(math.ceil(total / rows), len(sent) // (BUSY * at_once)))
    before, members = 0.0, [[] for _ in range(waves)]
    for block, size in sent.items():
        members[min(waves - 1, int((before + size / 2) * waves / total))].append(block)
        before += size
    most = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_once)
    tasks = max(1, min(most, max(map(len, members))))
    for w, blocks in enumerate(members):
        free = [(0, t) for t in range(tasks)]
        for block in sorted(blocks, key=lambda c: (-loads[c], c)):
            used, t = heapq.heappop(free)
            routing.tasks[block] = w, t
            heapq.heappush(free, (used + loads[block], t))
    return Routed(kept, copies, routing, waves, tasks)


def _sent(vectors: DataFrame, routed: Routed, dim: int, wave: int) -> DataFrame:
    """(task, cell, asks, id, v, ...) of the cells and blocks of a wave, with what else ``vectors`` has."""
    routing = routed.routing
    here = {c: t for c, (w, t) in routing.tasks.items() if w == wave}
    cut_up = {int(block_number(c, i)): c for c, (p, q) in routing.shards.items() for i in range(p * q)}
    cells_here = np.array(sorted({cut_up.get(b, b) for b in here}), np.int64)
    shards = {c: s for c, s in routing.shards.items() if c in set(cells_here.tolist())}
    shared = vectors.sparkSession.sparkContext.broadcast((routing.directions, routing.middle, shards, here, cells_here))
    more = [f for f in vectors.schema.fields if f.name not in ("id", "v")]

    def send(batches):
        directions, middle, shards, tasks, among = shared.value
        r = Routing(directions, middle, shards)
        numbers = np.array(sorted(tasks), np.int64)
        of = np.array([tasks[c] for c in numbers.tolist()], np.int32)
        for batch in batches:
            x = _unbinary(batch.column(1), dim)
            if not len(x) or not len(numbers):
                continue
            ids = np.asarray(batch.column(0))
            rows, cells, asks = r.blocks(*r.visits(_units(x), among), ids)
            # cells without rows of their own, and those of other waves, are in no task
            at = np.minimum(np.searchsorted(numbers, cells), len(numbers) - 1)
            m = numbers[at] == cells
            rows, cells, asks, at = rows[m], cells[m], asks[m], at[m]
            for i in range(0, len(rows), 50_000):
                k = slice(i, i + 50_000)
                columns = [pa.array(of[at[k]]), pa.array(cells[k]), pa.array(asks[k]), pa.array(ids[rows[k]]), _binary(x[rows[k]]), *[batch.column(2 + j).take(pa.array(rows[k])) for j in range(len(more))]]
                yield pa.RecordBatch.from_arrays(columns, names=["task", "cell", "asks", "id", "v", *[f.name for f in more]])

    schema = "task int, cell long, asks boolean, id long, v binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    return vectors.mapInArrow(send, schema).repartitionById(routed.tasks, F.col("task"))


def fine_hashing(n: int, cell: int) -> Hashing:
    """Inside a cell of n vectors: one hash more for twice the rows. Cells differ in their directions, so that a pair of which both visit the other's cell has two chances."""
    return Hashing(4, max(1, round(math.log2(max(1, n) / 400))), 1.7, 15, 7 + cell % 16)


def _pairs(x: np.ndarray, floor: float, reduce, cell: int, asks: np.ndarray | None) -> None:
    """Feed ``reduce`` with codes ``a * n + b`` of found pairs, a != b, in portions of bounded size; a is a row that asks."""
    n = len(x)
    held, count = [], 0
    for a, b in candidate_blocks(x, fine_hashing(n, cell), np.float32(floor - 1e-5), None if asks is None else np.flatnonzero(asks)):
        held.append(a * n + b)
        count += len(a)
        if count > _FOLD:
            reduce(np.unique(np.concatenate(held)))
            held, count = [], 0
    if held:
        reduce(np.unique(np.concatenate(held)))


def top_in_cell(ids: np.ndarray, x: np.ndarray, k: int, floor: float, cell: int = 0, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the k best other rows (highest cosine, then smaller id) of at least ``floor`` in pairs of which one asks (by default all do); ids must ascend."""
    n = len(x)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    best = [np.empty(0, np.int64), np.empty(0)]

    def reduce(codes):
        codes = np.setdiff1d(np.union1d(codes, codes % n * n + codes // n), best[0], assume_unique=True)
        cos = exact_cosines(x, norms, codes // n, codes % n)
        codes, cos = codes[cos >= floor], cos[cos >= floor]
        codes, cos = np.concatenate([best[0], codes]), np.concatenate([best[1], cos])
        order = np.lexsort((codes % n, -cos, codes // n))
        codes, cos = codes[order], cos[order]
        a = codes // n
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        best[0], best[1] = codes[keep], cos[keep]

    _pairs(_units(x), floor, reduce, cell, asks)
    return ids[best[0] // n], ids[best[0] % n], best[1]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Indices of the edges of the maximum spanning forest, by Borůvka rounds; order: w descending, then a, then b."""
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, -w))] = np.arange(len(a))
    by_rank = np.argsort(rank)
    comp, chosen, alive = np.arange(n), [], np.arange(len(a))
    while len(alive):
        ca, cb = comp[a[alive]], comp[b[alive]]
        out = ca != cb
        alive, ca, cb = alive[out], ca[out], cb[out]
        if not len(alive):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, ca, rank[alive])
        np.minimum.at(best, cb, rank[alive])
        c = np.flatnonzero(best < len(a))
        e = by_rank[best[c]]
        chosen.append(np.unique(e))
        parent = np.arange(n)
        parent[c] = np.where(comp[a[e]] == c, comp[b[e]], comp[a[e]])
        mutual = (parent[parent[c]] == c) & (c < parent[c])
        parent[c[mutual]] = c[mutual]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        comp = parent[comp]
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def forest_in_cell(ids: np.ndarray, x: np.ndarray, floor: float, core: np.ndarray | None, cell: int = 0, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum spanning forest of the pairs of at least ``floor``; weight: cosine, or mutual reachability where ``core`` is given."""
    n = len(x)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    kept = [np.empty(0, np.int64), np.empty(0)]

    def reduce(codes):
        a, b = codes // n, codes % n
        codes = np.setdiff1d(np.unique(np.minimum(a, b) * n + np.maximum(a, b)), kept[0])
        w = exact_cosines(x, norms, codes // n, codes % n)
        if core is not None:
            w = np.minimum(w, np.minimum(core[codes // n], core[codes % n]))
        codes, w = np.concatenate([kept[0], codes[w >= floor]]), np.concatenate([kept[1], w[w >= floor]])
        e = spanning_forest(n, codes // n, codes % n, w)
        order = np.argsort(codes[e])
        kept[0], kept[1] = codes[e][order], w[e][order]

    _pairs(_units(x), floor, reduce, cell, asks)
    return ids[kept[0] // n], ids[kept[0] % n], kept[1]


def _by_cell(routed: Routed, vectors: DataFrame, dim: int, work) -> DataFrame:
    """What ``work`` finds in all cells and blocks, wave by wave; the files of a wave are gone before the next begins."""

    def one(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("id"))
        order = np.lexsort((~np.asarray(table.column("asks")), ids))
        order = order[np.append(True, np.diff(ids[order]) > 0)]
        x = _unbinary(table.column("v"), dim)[order]
        asks = np.asarray(table.column("asks"))[order]
        core = np.asarray(table.column("core"))[order] if "core" in table.column_names else None
        a, b, w = work(ids[order], x, core, table.column("cell")[0].as_py(), asks)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "w": pa.array(w, pa.float64())})

    found = [cut(_sent(vectors, routed, dim, wave).groupBy("task", "cell").applyInArrow(one, "a long, b long, w double")) for wave in range(routed.waves)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def nearest(routed: Routed, dim: int, k: int, floor: float) -> DataFrame:
    """(a, b, w): for each vector of the table the k others of highest cosine, then smaller id, with a cosine of at least ``floor``.

    Copies of a vector count as others of cosine 1. Linear in the number of rows, however many
    copies there are: a class of copies is searched once, and its members get the class's list.
    """
    found = _by_cell(routed, routed.vectors, dim, lambda ids, x, _, cell, asks: top_in_cell(ids, x, k, floor, cell, asks))
    by = F.struct((-F.col("w")).alias("o"), "b")
    ranked = found.withColumn("r", F.dense_rank().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).filter(F.col("r") <= k)
    best = ranked.groupBy("a", "b").agg(F.max("w").alias("w"))
    if not routed.copies.head(1):
        return best
    copies = routed.copies
    least = copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1)
    some = bounded(least.groupBy("rep").agg(F.collect_list("id").alias("ids")))
    own = some.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("w"))
    wide = best.unionByName(own).join(some, F.col("b") == F.col("rep"), "left")
    wide = wide.select("a", "w", F.explode(F.coalesce("ids", F.array("b"))).alias("b"))
    wide = wide.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).filter(F.col("r") <= k + 1)
    members = bounded(copies.withColumnRenamed("rep", "a"))
    each = wide.join(members, "a", "left").select(F.coalesce("id", "a").alias("a"), "b", "w").filter("a <> b")
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).filter(F.col("r") <= k)
    return each.select("a", "b", "w")


def forest_edges(routed: Routed, dim: int, floor: float, core: DataFrame | None = None) -> DataFrame:
    """(a, b, w), a < b: edges whose maximum spanning forest is that of all found pairs of at least ``floor``; linear in the rows.

    Each cell sends only its own spanning forest, for an edge outside it is in no overall one.
    ``core`` (id, core) turns the weight into mutual reachability.
    """
    vectors = routed.vectors if core is None else cut(routed.vectors.join(core, "id"))
    found = _by_cell(routed, vectors, dim, lambda ids, x, c, cell, asks: forest_in_cell(ids, x, floor, c, cell, asks))
    if core is not None:
        drop(vectors)
    return found.dropDuplicates(["a", "b"])
