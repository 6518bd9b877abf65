"""Subject areas of documents: bisecting k-means over the corpus, leaves labelled by discriminative terms, leaf mixtures.

All documents, as normalised vectors of their most telling terms, are clustered by bisecting k-means. A leaf gets its
subjects from the terms that set it off from the corpus, as far as labelled texts say what these are about. A term's
subjects are those of the leaves in which more documents hold it than by chance, over all documents; a document's subjects follow from
the mixture of leaves that its terms point to. Labelled texts say nothing about a document directly: without leaves there are no subjects.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.plans.scratch import cut

EXAMPLES = 20_000  #: most labelled texts the classifier is fitted on, least ids first; all their terms are its vocabulary
REPEATED = 2e-4  #: of the documents, and at least 5, have to hold a word that joins the vocabulary because it repeats inside them
BURST = 1.4  #: mean occurrences in the documents that hold a word, from which it counts as repeating
DIMENSIONS = 1500  #: terms that span the vectors for clustering
AXES, PASSES = 40, 3  #: main axes of the vectors, and passes to find them
LEAVES = 300  #: a leaf with less than a LEAVES-th of the documents is not split
LEVELS = 8  #: of splits, with one pass over the vectors each
TELLING = 25  #: discriminative terms that label a leaf
KNOWN = 3  #: labelled texts from which they alone say whether a term is topical
TOPICAL = 0.5  #: information of a term on the subject, in nats, or further occurrences inside documents, from which it is a dimension
CLEAR = 0.2  #: mean information of a leaf's telling terms on subjects, from which it points to them in full
FEW = 2.0  #: documents that the corpus as a whole counts for in a term's mixture of leaves
BEYOND = 0.3  #: of a term's documents that have to be more than chance gives its leaves
SURE = 0.8  #: share of a term's mixture from which it speaks for a subject
MENTIONS, SHARE = 2, 0.25  #: a subject needs so many mentions and such a share of all mentions
MOST = 2  #: subjects of a document, those with most mentions: a text is about one area, two or none
_PIECE = re.compile(r"[.!?\n,;:]+")
_WORD = re.compile(r"[^\W_]+")


def pieces(text: str | None) -> list[list[str]]:
    """The words of every clause, lower-cased, numbers left out; none for a null text."""
    return [w for p in _PIECE.split(text.lower()) if (w := [x for x in _WORD.findall(p) if not x.isdigit()])] if text else []


def terms(text: str | None) -> list[str]:
    """Words and pairs of neighbouring words within a clause."""
    return [t for w in pieces(text) for t in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:])))]


@dataclass
class Labelled:
    """Counts of the labelled texts."""

    subjects: list[str]
    vocabulary: dict[str, int]
    counts: np.ndarray  #: texts that hold a term, by subject; texts of two subjects count half for each
    totals: np.ndarray  #: texts that hold a term
    prior: np.ndarray
    burst: np.ndarray  #: how far a term repeats inside documents of the corpus, 0 to 1; 0 where unknown


def repeating(docs: DataFrame, text: str, known: Labelled) -> Labelled:
    """``known`` with the words of the corpus, labelled or not, that documents tend to repeat, as words of their subject are.

    Counts cover all documents; a word in less than ``REPEATED`` of them is left out, so at most 1 / ``REPEATED`` times the mean number of
    different words of a document can join.
    """

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for x in batch.column(0).to_pylist():
                mine: dict[str, int] = {}
                for w in _WORD.findall(x.lower()) if x else ():
                    mine[w] = mine.get(w, 0) + 1
                for w, n in mine.items():
                    both = seen.setdefault(w, [0, 0])
                    both[0] += 1
                    both[1] += n
            if len(seen) > 300_000:
                yield _rows(seen)
                seen = {}
        yield _rows(seen)

    least = max(5, int(REPEATED * docs.count()))
    words = docs.select(F.col(text).alias("text")).mapInArrow(count, "w string, df long, tf long").groupBy("w").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    often = words.filter((F.col("df") >= least) & (F.col("tf") >= BURST * F.col("df")) & ~F.col("w").rlike("^[0-9]+$"))
    rows = sorted(often.collect(), key=lambda r: r["w"])
    vocabulary = dict(known.vocabulary)
    for r in rows:
        vocabulary.setdefault(r["w"], len(vocabulary))
    more = len(vocabulary) - len(known.vocabulary)
    burst = np.zeros(len(vocabulary))
    for r in rows:
        burst[vocabulary[r["w"]]] = min(1.0, r["tf"] / r["df"] - 1)
    counts = np.concatenate([known.counts, np.zeros((more, len(known.subjects)))])
    return Labelled(known.subjects, vocabulary, counts, np.append(known.totals, np.zeros(more)), known.prior, burst)


def _rows(seen: dict[str, list[int]]) -> pa.RecordBatch:
    df, tf = ([v[i] for v in seen.values()] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(df, pa.int64()), pa.array(tf, pa.int64())], names=["w", "df", "tf"])


def labelled(examples: DataFrame, key: str, text: str, subjects: str) -> Labelled:
    rows = examples.filter(F.col(text).isNotNull()).orderBy(key).limit(EXAMPLES).select(text, subjects).collect()
    names = sorted({s.strip().lower() for r in rows for s in (r[1] or []) if s})
    at = {s: i for i, s in enumerate(names)}
    seen: dict[str, int] = {}
    held = [set(terms(r[0])) for r in rows]
    for h in held:
        for t in h:
            seen[t] = seen.get(t, 0) + 1
    kept = sorted(seen)
    vocabulary = {t: i for i, t in enumerate(kept)}
    counts, totals, prior = np.zeros((len(kept), len(names))), np.zeros(len(kept)), np.zeros(len(names))
    for r, h in zip(rows, held):
        ids = [vocabulary[t] for t in h if t in vocabulary]
        totals[ids] += 1
        mine = sorted({at[s.strip().lower()] for s in (r[1] or []) if s})
        for s in mine:
            counts[ids, s] += 1 / len(mine)
            prior[s] += 1 / len(mine)
    return Labelled(names, vocabulary, counts, totals, prior / max(1, len(rows)) + 1e-9, np.zeros(len(kept)))


def _read(texts: list, at: dict[str, int]) -> list[list[int]]:
    """For each text a list of (term of a word, term of the pair that it begins), one after the other, -1 where the vocabulary has none; stretches and ends of clauses without are one (-1, -1)."""
    out = []
    for x in texts:
        ids: list[int] = []
        for w in pieces(x):
            for i, a in enumerate(w):
                u, b = at.get(a, -1), at.get(f"{a} {w[i + 1]}", -1) if i + 1 < len(w) else -1
                if u >= 0 or b >= 0 or ids[-2:] != [-1, -1]:
                    ids += (u, b)
            if ids[-2:] != [-1, -1]:
                ids += (-1, -1)
        out.append(ids)
    return out


def _sparse(docs: DataFrame, key: str, text: str, known: Labelled, place: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(key, terms, d, v): the terms of each document, whole texts, and its unit vector."""
    shared = docs.sparkSession.sparkContext.broadcast((known.vocabulary, place, weight))

    def apply(batches):
        at, place, weight = shared.value
        for batch in batches:
            ids = pa.array(_read(batch.column(1).to_pylist(), at), pa.list_(pa.int32()))
            n, row, term = _flat(ids)
            x = _vectors(n, row[term >= 0], term[term >= 0], place, weight)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(x.row, minlength=n))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (x.d.astype(np.int16), x.value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *lists], names=["key", "terms", "d", "v"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(apply, "key long, terms array<int>, d array<short>, v array<float>")


@dataclass
class Rows:
    """Sparse unit vectors: ``value`` at (``row``, ``d``); ``n`` rows, of which those without any entry take no part."""

    n: int
    row: np.ndarray
    d: np.ndarray
    value: np.ndarray


def _flat(column) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows of a list column, and its (row, term) pairs."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
    return len(sizes), np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten())


def _vectors(n: int, row: np.ndarray, term: np.ndarray, place: np.ndarray, weight: np.ndarray) -> Rows:
    """Unit vectors of capped counts times weights."""
    d = place[term]
    code, count = np.unique(row[d >= 0] * len(weight) + d[d >= 0], return_counts=True)
    row, d = code // len(weight), code % len(weight)
    value = np.minimum(count, 3) * weight[d]
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    return Rows(n, row, d, value / norm[row])


class Tree:
    """Splits of nodes: the first child of a node, and the direction and bound beyond which a vector belongs to the second one."""

    def __init__(self, axes: np.ndarray):
        self.axes = axes  #: of the terms' dimensions, a row each
        self.child = np.full(1, -1)
        self.lean = np.zeros((1, axes.shape[1]))
        self.bound = np.zeros(1)

    def dense(self, x: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors along the axes, and which rows have any."""
        y = np.zeros((x.n, self.axes.shape[1]))
        starts = np.flatnonzero(np.append(True, x.row[1:] != x.row[:-1])) if len(x.row) else np.empty(0, np.int64)
        if len(starts):
            y[x.row[starts]] = np.add.reduceat(self.axes[x.d] * x.value[:, None], starts)
        norm = np.sqrt((y * y).sum(axis=1))
        return y / np.maximum(norm, 1e-12)[:, None], norm > 1e-9

    def split(self, node: int, direction: np.ndarray, bound: float) -> None:
        n, r = len(self.child), self.lean.shape[1]
        self.child, self.lean, self.bound = np.append(self.child, [-1, -1]), np.concatenate([self.lean, np.zeros((2, r))]), np.append(self.bound, [0.0, 0.0])
        self.child[node], self.lean[node], self.bound[node] = n, direction, bound

    def recentre(self, node: int, sums: dict[int, np.ndarray]) -> None:
        """From now on the nearer centre decides."""
        first = self.child[node]
        if first in sums and first + 1 in sums:
            r = self.lean.shape[1]
            one, two = (sums[c][:r] / max(1e-9, np.linalg.norm(sums[c][:r])) for c in (first, first + 1))
            self.lean[node], self.bound[node] = two - one, 0.0

    def leaves(self, y: np.ndarray) -> np.ndarray:
        """The leaf of every row, level by level."""
        node = np.zeros(len(y), np.int64)
        while (self.child[node] >= 0).any():
            right = (y * self.lean[node]).sum(axis=1) > self.bound[node]
            node = np.where(self.child[node] >= 0, self.child[node] + right, node)
        return node


def _stored(d, v) -> Rows:
    n, row, at = _flat(d)
    return Rows(n, row, at.astype(np.int64), _flat(v)[2].astype(np.float64))


def _summed(rows: DataFrame) -> dict[int, dict]:
    """Sums of (node, d, s) by node and d, as arrays (d, s) a node."""
    table = rows.groupBy("node", "d").agg(F.sum("s").alias("s")).toArrow()
    node, d, s = (np.asarray(table.column(c)) for c in ("node", "d", "s"))
    order = np.argsort(node, kind="stable")
    edge = np.append(np.flatnonzero(np.append(True, np.diff(node[order]) > 0)), len(node)) if len(node) else np.zeros(1, np.int64)
    return {int(node[order[i]]): (d[order[i:j]], s[order[i:j]]) for i, j in zip(edge, edge[1:])}


def _axes(sparse: DataFrame, dimensions: int) -> np.ndarray:
    """The main axes of all vectors, by subspace iteration: terms that occur in the same documents come to lie alike.

    Each pass multiplies the axes with the vectors there and back, DIMENSIONS x AXES sums a task, and the driver makes them orthogonal.
    """
    r = min(AXES, dimensions)
    axes = np.linalg.qr(np.random.default_rng(5).standard_normal((dimensions, r)))[0]
    for _ in range(PASSES):
        shared = sparse.sparkSession.sparkContext.broadcast(axes)

        def there_and_back(batches, shared=shared):
            e = shared.value
            total = np.zeros(e.shape)
            for batch in batches:
                x = _stored(batch.column(0), batch.column(1))
                if not len(x.row):
                    continue
                starts = np.flatnonzero(np.append(True, x.row[1:] != x.row[:-1]))
                y = np.add.reduceat(e[x.d] * x.value[:, None], starts)
                back = np.repeat(y, np.diff(np.append(starts, len(x.row))), axis=0) * x.value[:, None]
                order = np.argsort(x.d, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(x.d[order]) > 0))
                total[x.d[order[at]]] += np.add.reduceat(back[order], at)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(total.size, np.int64)), pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["node", "d", "s"])

        found = _summed(sparse.select("d", "v").mapInArrow(there_and_back, "node long, d long, s double")).get(0)
        if found is None:
            break
        total = np.zeros(dimensions * r)
        total[found[0]] = found[1]
        axes = np.linalg.qr(total.reshape(dimensions, r))[0]
    return axes


def _grow(sparse: DataFrame, dimensions: int) -> Tree:
    """Bisecting k-means over all documents, all large leaves of a level at once, with one pass a level.

    A pass sends every vector down the tree and sums, per node, vectors and their products of pairs, partially in every task. A node is split across its
    widest direction at first; the next pass gives its children's centres, and from then on the nearer centre decides, so that each further pass also is a step of k-means for all
    levels above. At most 2 ** LEVELS nodes' sums reach the driver.
    """
    spark = sparse.sparkSession
    tree = Tree(_axes(sparse, dimensions))
    r = tree.axes.shape[1]
    size = r + r * r + 1

    def sums():
        shared = spark.sparkContext.broadcast(tree)

        def apply(batches):
            t = shared.value
            total = np.zeros((len(t.child), size))
            for batch in batches:
                y, some = t.dense(_stored(batch.column(0), batch.column(1)))
                y = y[some]
                node = t.leaves(y)
                for n in np.unique(node).tolist():
                    z = y[node == n]
                    total[n] += np.concatenate([z.sum(axis=0), (z.T @ z).ravel(), [len(z)]])
            node, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(d), pa.array(total[node, d])], names=["node", "d", "s"])

        out = {}
        for n, (d, s) in _summed(sparse.select("d", "v").mapInArrow(apply, "node long, d long, s double")).items():
            out[n] = np.zeros(size)
            out[n][d] = s
        return out

    total = 0.0
    for level in range(LEVELS + 1):
        now = sums()
        total = total or sum(v[-1] for v in now.values())
        every: dict[int, np.ndarray] = {}
        for n in range(len(tree.child) - 1, -1, -1):  # sums of inner nodes, from their children
            parts = [x for x in ([every.get(c) for c in (tree.child[n], tree.child[n] + 1)] if tree.child[n] >= 0 else [now.get(n)]) if x is not None]
            if parts:
                every[n] = sum(parts)
        for n in np.flatnonzero(tree.child >= 0).tolist():
            tree.recentre(n, every)
        if level == LEVELS:
            break
        grown = False
        for n in sorted(n for n, v in now.items() if v[-1] > max(20, total / LEAVES)):
            mean = now[n][:r] / now[n][-1]
            values, vectors = np.linalg.eigh(now[n][r:-1].reshape(r, r) / now[n][-1] - np.outer(mean, mean))
            if values[-1] > 1e-9:
                # the sign of an axis is free; this one does not depend on the library
                v = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
                tree.split(n, v, float(mean @ v))
                grown = True
        if not grown:
            break
    return tree


def _spanned(known: Labelled) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat, gain, place, weight): the subjects of terms by the labelled texts, what they tell, and the dimensions of the vectors with their weights."""
    k = len(known.subjects)
    flat = (known.counts + 2 * known.prior) / (known.totals[:, None] + 2)
    gain = (flat * np.log(np.maximum(flat / known.prior, 1e-9))).sum(axis=1)
    gain = np.maximum(0, gain - 0.5 * (k - 1) / (2 * (known.totals + 2)))
    # where enough labelled texts hold a term these decide, else what repeats inside documents counts too
    pull = np.where(known.totals >= KNOWN, gain, np.maximum(gain, known.burst))
    top = np.argsort(-(pull * np.minimum(np.maximum(known.totals, KNOWN * (known.burst > 0)), KNOWN)), kind="stable")[:DIMENSIONS]
    top = top[pull[top] >= TOPICAL]
    if not len(top):
        top = np.array([0])
    place = np.full(len(known.vocabulary), -1)
    place[top] = np.arange(len(top))
    return flat, gain, place, pull[top].astype(np.float32)


def _leaf_counts(sparse: DataFrame, tree: Tree, size: int) -> DataFrame:
    """(node, t, n): documents of each leaf that hold a term; t = -1 counts all its documents."""
    shared = sparse.sparkSession.sparkContext.broadcast(tree)

    def count(batches):
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x = _stored(batch.column(1), batch.column(2))
            n, row, term = _flat(batch.column(0))
            y, some = shared.value.dense(x)
            node = np.where(some, shared.value.leaves(y), -1)
            pairs = np.unique(row[term >= 0] * size + term[term >= 0])
            pairs = pairs[node[pairs // size] >= 0]
            codes = np.concatenate([node[pairs // size] * (size + 1) + pairs % size, node[node >= 0] * (size + 1) + size])
            codes, many = np.unique(np.concatenate([seen[0], codes]), return_inverse=True)
            counts = np.bincount(many, np.concatenate([seen[1], np.ones(len(many) - len(seen[1]))])).astype(np.int64)
            seen = codes, counts
            if len(codes) > 2_000_000:
                yield rows(*seen)
                seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows(*seen)

    def rows(codes, counts):
        t = codes % (size + 1)
        return pa.RecordBatch.from_arrays([pa.array(codes // (size + 1)), pa.array(np.where(t == size, -1, t)), pa.array(counts)], names=["node", "t", "n"])

    return sparse.select("terms", "d", "v").mapInArrow(count, "node long, t long, n long").groupBy("node", "t").agg(F.sum("n").alias("n"))


def speakers(sparse: DataFrame, tree: Tree, known: Labelled, flat: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The main subject of the mixture of leaves that each term points to, or -1, and its share."""
    spark, size, k = sparse.sparkSession, len(known.vocabulary), len(known.subjects)
    counts = cut(_leaf_counts(sparse, tree, size))
    docs_in = {r["node"]: r["n"] for r in counts.filter("t = -1").collect()}  # one row a leaf
    total = sum(docs_in.values())
    says, share = np.full(size, -1), np.zeros(size)
    if not total:
        return says, share
    leaf = spark.createDataFrame([(n, float(m)) for n, m in docs_in.items()], "node long, docs double")
    every = counts.filter("t >= 0").groupBy("t").agg(F.sum("n").alias("all"))
    rows = counts.filter("t >= 0").join(F.broadcast(leaf), "node").join(every, "t")
    lift = (F.col("n") / F.col("docs")) * F.log(F.col("n") * F.lit(float(total)) / (F.col("docs") * F.col("all")))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("lift"), "t"))
    telling = rows.filter("n >= 3").withColumn("lift", lift).filter("lift > 0").withColumn("r", best).filter(F.col("r") <= TELLING).select("node", "t", "lift").collect()
    subject, weight = {n: np.zeros(k) for n in docs_in}, dict.fromkeys(docs_in, 0.0)
    for r in telling:
        subject[r["node"]] += r["lift"] * gain[r["t"]] * (flat[r["t"]] - known.prior).clip(0)
        weight[r["node"]] += r["lift"]
    # a leaf whose telling terms say little of any subject points to none, as far as they do
    subject = {n: v**2 / max((v**2).sum(), 1e-12) * min(1.0, v.sum() / max(weight[n], 1e-12) / CLEAR) for n, v in subject.items()}
    of = spark.createDataFrame([(n, v.tolist()) for n, v in subject.items()], "node long, subject array<double>")
    # documents beyond those that chance would give the leaf, times how far they are beyond
    chance = F.col("docs") * F.col("all") / F.lit(float(total))
    points = rows.withColumn("x", (F.col("n") - chance) * F.log(F.col("n") / chance)).filter(F.col("n") > chance).join(F.broadcast(of), "node")
    mixed = points.groupBy("t").agg(F.sum("x").alias("x"), (F.sum(F.col("n") - chance) / F.max("all")).alias("beyond"), *[F.sum(F.col("x") * F.col("subject")[i]).alias(f"s{i}") for i in range(k)]).toArrow()
    mix = np.stack([np.asarray(mixed.column(f"s{i}")) for i in range(k)], axis=1).reshape(-1, k)
    base = sum(docs_in[n] * v for n, v in subject.items()) / sum(docs_in[n] for n in subject)
    mix = (mix + FEW * base) / (np.asarray(mixed.column("x"))[:, None] + FEW)
    t = np.asarray(mixed.column("t"))
    # a word of all texts is a little more frequent somewhere, too: that says nothing
    says[t], share[t] = mix.argmax(axis=1), np.where(np.asarray(mixed.column("beyond")) >= BEYOND, mix.max(axis=1), 0)
    return says, share


def mentions(n: int, row: np.ndarray, term: np.ndarray, says: np.ndarray, k: int) -> np.ndarray:
    """Mentions of every subject in each of n documents, from the flat lists of ``_read``. Neighbouring words that speak for one subject are one mention."""
    word, pair, row = term[::2], term[1::2], row[::2]
    s = np.append(says, -1)  # -1 of an unknown term is the last one
    claim = s[word]
    by_pair = s[pair]
    before = np.append(-1, by_pair[:-1])[: len(by_pair)]
    claim = np.where(by_pair >= 0, by_pair, np.where((before >= 0) & (word >= 0), before, claim))
    fresh = claim >= 0
    fresh[1:] &= (claim[1:] != claim[:-1]) | (row[1:] != row[:-1])
    out = np.zeros((n, k), np.int64)
    np.add.at(out, (row[fresh], claim[fresh]), 1)
    return out


def classified(docs: DataFrame, key: str, text: str, known: Labelled) -> DataFrame:
    """(key, subjects, mentions): the subjects of every document with a key, sorted, and the number of mentions of any.

    Null, empty and blank texts, and texts without telling terms, have no subjects. Every document takes part in the clustering
    and in the counts of terms by leaf.
    """
    spark = docs.sparkSession
    docs = docs.filter(F.col(key).isNotNull())
    known = repeating(docs, text, known)
    k = len(known.subjects)
    if not known.vocabulary or not k:
        return docs.select(F.col(key).cast("long").alias("key"), F.array().cast("array<string>").alias("subjects"), F.lit(0).cast("long").alias("mentions"))
    flat, gain, place, weight = _spanned(known)
    sparse = cut(_sparse(docs, key, text, known, place, weight))
    tree = _grow(sparse, len(weight))
    says, share = speakers(sparse, tree, known, flat, gain)
    told = spark.sparkContext.broadcast((np.where(share >= SURE, says, -1), known.subjects))

    def decide(batches):
        says, names = told.value
        for batch in batches:
            mix = mentions(*_flat(batch.column(1)), says, len(names))
            total = mix.sum(axis=1)
            place_in_mix = np.argsort(np.argsort(-mix, axis=1, kind="stable"), axis=1)
            yes = (mix >= MENTIONS) & (mix >= SHARE * total[:, None]) & (place_in_mix < MOST)
            found = [[names[j] for j in np.flatnonzero(y)] for y in yes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(total)], names=["key", "subjects", "mentions"])

    return sparse.select("key", "terms").mapInArrow(decide, "key long, subjects array<string>, mentions long")
