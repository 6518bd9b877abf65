"""Evaluation passages inside a corpus: template windows, hash join, slot consistency.

Words are canonicalised to templates: numbers, names and units become typed placeholders, so a window of a passage
meets the same window with other values. Windows of templates are joined by hash; where they meet, the
values in the slots decide: all slots hold the item's own values (a copy), or one value stands for another throughout
the run (a re-parameterised question), or neither (chance).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.words import words
from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut

WINDOW = 13  #: words of a window
BITS = 1 << 26  #: of a Bloom filter, 8 MB whatever it holds; a fuller one lets more windows through to the join, where they fall away
#: Units of measure (fixed values).
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros degree degrees watt watts volt volts".split())
#: Number words (fixed values).
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_KINDS = {kind: np.uint64(xxhash.xxh64_intdigest(f"<{kind}>")) for kind in ("number", "unit", "name")}


_CAPITAL = re.compile("[^A-Za-z0-9]*([A-Z][A-Za-z]*)")
_SENTENCE = (".", "!", "?", ":", '"', "'")


def proper_names(passage: str | None) -> tuple[set[str], set[str]]:
    """Of a passage: words written with a capital though no sentence begins there, and words in lower case; the first without the second are names."""
    inner, other = set(), set()
    tokens = (passage or "").split()
    for before, t in zip(tokens, tokens[1:]):
        m = _CAPITAL.match(t)
        if m and not before.endswith(_SENTENCE):
            inner.add(m[1].lower())
    for w in re.findall("[A-Za-z]+", passage or ""):
        if w.islower():
            other.add(w)
    return inner, other


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A Bloom filter with one bit for each ``h`` (long), built by partial aggregates; at most ``bits`` / 64 rows reach the driver."""
    place = hashes.select((F.col("h").bitwiseAND(F.lit(bits - 1))).alias("p"))
    words_ = place.groupBy(F.expr("shiftright(p, 6)").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(words_.column("i"))] = np.asarray(words_.column("w")).view(np.uint64)
    return out


def _in(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(filter_) * 64 - 1)
    return (filter_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


class _Numbers:
    """Hashes of words as template, and whether they fill a slot, kept between texts."""

    def __init__(self, names: np.ndarray):
        self.names, self.at, self.template, self.slot = names, {}, [], []

    def add(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w)
        kind = "number" if w[0].isdigit() or w in NUMBERS else "unit" if w in UNITS else "name" if _in(self.names, np.array([h], np.uint64))[0] else None
        self.template.append(int(_KINDS[kind]) if kind else h)
        self.slot.append(kind is not None)
        self.at[w] = len(self.template) - 1
        return self.at[w]

    def hashes(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.template) > 1_000_000:
            self.__init__(self.names)
        at = self.at
        ids = np.fromiter((at[w] if w in at else self.add(w) for w in tokens), np.int64, len(tokens))
        return np.array(self.template, np.uint64)[ids], np.array(self.slot, bool)[ids]


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A rolling 64-bit hash of every run of ``size`` numbers."""
    n = len(h)
    if n < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, _P, np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(h * powers[:n]))
        back = np.cumprod(np.append(np.uint64(1), np.full(n - size, _INVERSE, np.uint64)))
        return (sums[size:] - sums[: n - size + 1]) * back


def template_windows(texts: DataFrame, names: np.ndarray, known: np.ndarray | None, size: int) -> DataFrame:
    """(h, id, at, w, slots) of texts (id, text): the hash of every window's template, its place, its words and a bit for each that fills a slot.

    With ``known``, a Bloom filter, only windows whose hash it has. Texts of fewer than ``size`` words have no window.
    """
    shared = texts.sparkSession.sparkContext.broadcast((names, known))

    def apply(batches):
        numbers = _Numbers(shared.value[0])
        known = shared.value[1]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                tokens = [words(t) for t in part.column(1).to_pylist()]
                flat = [w for d in tokens for w in d]
                if len(flat) < size:
                    continue
                ends = np.cumsum([len(d) for d in tokens])
                template, slot = numbers.hashes(flat)
                h = windows(template, size)
                at = np.arange(len(h)) if known is None else np.flatnonzero(_in(known, h))
                doc = np.searchsorted(ends, at, side="right")
                inside = at + size <= ends[doc]
                at, doc = at[inside], doc[inside]
                bits = np.zeros(len(at), np.int64)
                for k in range(size):
                    bits |= slot[at + k].astype(np.int64) << k
                starts = np.append(0, ends[:-1])
                columns = [pa.array(h[at].view(np.int64)), part.column(0).take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32)), pa.array([" ".join(flat[x : x + size]) for x in at.tolist()], pa.string()), pa.array(bits)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "id", "at", "w", "slots"])

    return texts.mapInArrow(apply, "h long, id long, at int, w string, slots long")


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, exact, altered, changed) of documents that share windows with items.

    exact: windows whose slots all hold the item's own values, so that they are equal word by word. altered: further windows, of runs in
    which every slot value of the item stands for one value throughout, and different ones for different values; changed: values that differ in
    the run that changes most. Whole texts are read where they lie; only windows that pass a Bloom filter of the items' windows
    travel, to a join by hash. Items are neither bounded nor collected: their names and windows reach the tasks as such filters.
    Items with fewer than ``size`` words, null passages and null texts match nothing; rows without a key are left out; repeated rows count once.
    """
    items = items.select(F.col(item_key).cast("long").alias("id"), F.col(passage).alias("text")).dropna()
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).dropna()

    def capitals(batches):
        for batch in batches:
            inner: set[str] = set()
            other: set[str] = set()
            for t in batch.column(1).to_pylist():
                a, b = proper_names(t)
                inner, other = inner | a, other | b
            every = sorted(inner | other)
            h = np.array([xxhash.xxh64_intdigest(w) for w in every], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([w in other for w in every], pa.bool_())], names=["h", "low"])

    written = items.mapInArrow(capitals, "h long, low boolean").groupBy("h").agg(F.bool_or("low").alias("low"))
    names = bitmap(written.filter("NOT low"))
    asked = cut(template_windows(items, names, None, size).distinct())
    known = bitmap(asked.select("h").distinct())
    met = template_windows(docs, names, known, size)
    met = met.select("h", F.col("id").alias("doc_id"), F.col("at").alias("there"), F.split("w", " ").alias("d"))
    asked = bounded(asked.select("h", F.col("id").alias("item_id"), "at", "slots", F.split("w", " ").alias("i")))
    both = met.join(asked, "h").withColumn("shift", F.col("there") - F.col("at"))
    # hash first, then word by word outside the slots: what only its hash has in common falls away
    place = F.sequence(F.lit(0), F.lit(size - 1))
    fills = lambda k: F.getbit("slots", k) == 1
    both = both.filter(F.forall(place, lambda k: fills(k) | (F.get("d", k) == F.get("i", k))))
    values = F.transform(F.filter(place, fills), lambda k: F.struct(F.get("i", k).alias("own"), F.get("d", k).alias("other")))
    both = both.select("doc_id", "item_id", "shift", F.struct("at", values.alias("v")).alias("x"))
    runs = both.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("x").alias("x"))
    pairs = F.array_distinct(F.flatten(F.transform("x", lambda x: x["v"])))
    same = F.size(F.filter("x", lambda x: F.forall(x["v"], lambda v: v["own"] == v["other"])))
    runs = runs.select("doc_id", "item_id", F.size("x").alias("n"), same.alias("same"), pairs.alias("p"))
    fits = (F.size("p") == F.size(F.array_distinct(F.transform("p", lambda v: v["own"])))) & (F.size("p") == F.size(F.array_distinct(F.transform("p", lambda v: v["other"]))))
    differ = F.size(F.filter("p", lambda v: v["own"] != v["other"]))
    runs = runs.select("doc_id", "item_id", "same", F.when(fits, F.col("n") - F.col("same")).otherwise(0).alias("altered"), F.when(fits, differ).otherwise(0).alias("changed"))
    out = runs.groupBy("doc_id", "item_id").agg(F.sum("same").cast("long").alias("exact"), F.sum("altered").cast("long").alias("altered"), F.max("changed").cast("long").alias("changed"))
    return out.filter("exact > 0 OR altered > 0")
