import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftspark.llm import bpe, capping, cutoffs, leaks, subjects
from siftspark.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def scored(spark, rows):
    return spark.createDataFrame(rows, "src string, sub string, s double, p int, n string, lo double")


def test_cutoffs_against_sorting(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", f"g{min(i % 11, 3)}", rng.choice([rng.random(), 0.5, 0.25]), 350 if i % 3 else 620, "clash", 0.0) for i in range(900)]
    rows += [("a", "one", 0.4, 350, "", 0.0), ("a", None, 0.4, 350, "", 0.0), ("a", "g0", None, 350, "", 0.0), ("a", "g0", float("nan"), 350, "", 0.0), ("c", "none", 0.3, 0, "", 0.0), ("c", "x", 0.3, None, "", 0.0)]
    got = {(r["src"], r["sub"]): (r["n"], r["target"], r["cutoff"], r["kept"]) for r in cutoffs.cutoffs(scored(spark, rows), ["src", "sub"], "s", "p").collect()}
    want: dict = {}
    for a, b, s, p, *_ in rows:
        if b is not None and s is not None and not math.isnan(s) and p is not None:
            want.setdefault((a, b), (p, []))[1].append(s)
    for key, (p, values) in want.items():
        target = -(-len(values) * p // 1000)
        cut = sorted(values, reverse=True)[target - 1] if target else None
        assert got[key] == (len(values), target, cut, sum(v >= cut for v in values) if target else 0)
    assert set(got) == set(want)


def test_cutoffs_of_nothing(spark):
    assert cutoffs.cutoffs(scored(spark, []), ["src", "sub"], "s", "p").count() == 0


@pytest.mark.parametrize("parts", [2, 7])
def test_positions_with_a_dominant_owner(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [("hot" if i % 3 else f"o{i % 40}", (i % 10) / 10, f"k{i:05d}", "clash") for i in range(1500)]
        rows += [("hot", 0.9, "k00001", ""), (None, 0.1, "x", ""), ("o1", None, "y", ""), ("o1", 0.5, None, "")]
        df = spark.createDataFrame(rows, "owner string, score double, key string, n string")
        got = sorted((r["owner"], r["position"], r["key"]) for r in capping.positions(df, "owner", "score", "key").collect())
        want = []
        for o in {r[0] for r in rows if r[0]}:
            mine = sorted((-s, k) for a, s, k, _ in rows if a == o and s is not None and k is not None)
            want += [(o, i + 1, k) for i, (_, k) in enumerate(mine)]
        assert got == sorted(want)
        assert capping.positions(df.limit(0), "owner", "score", "key").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken")


def test_merges_agree_with_the_public_library(ranks):
    import tiktoken

    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "Hello, world! it's 12345   \n\n\t x", "<|endoftext|> is text", "ä ß 漢字 🙂🙂 ​\x00\x07", "a" * 5000, " " * 3000 + "b", "".join(rng.choice("abc de\né漢") for _ in range(20_000))]
    encoder = bpe.Encoder(ranks)
    for t in texts:
        assert encoder.encode(t) == public.encode_ordinary(t)
    assert encoder.encode(None) == []


def test_scan_and_heap_agree(ranks):
    rng = random.Random(4)
    for _ in range(300):
        w = bytes(rng.choice(b"abcdefgh ething\xc3\xa9") for _ in range(rng.randint(1, 90)))
        ids = bpe.merge_short(w, ranks)
        assert ids == bpe.merge_long(w, ranks)
        back = {v: k for k, v in ranks.items()} if _ == 0 else back  # noqa: F821
        assert b"".join(back[i] for i in ids) == w


def test_encoded_rows(spark, ranks):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), len(r["ids"])) for r in bpe.encoded(df, "doc_id", "text", ranks).collect())
    assert got == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encoded(df.limit(0), "doc_id", "text", ranks).count() == 0


PASSAGE = "For each spare token Anna Berg traded 144 chalk marks and while the bells rang 49 badges were mislaid near the old bandstand at 12 km before noon"


def test_leaks(spark):
    w = PASSAGE.split()
    other = PASSAGE.replace("144", "99").replace("49", "7").replace("12", "3").replace("km", "miles")
    docs = [(1, "Intro. " + PASSAGE.upper() + " the end"), (2, " ".join(w[3:16])), (3, " ".join(w[3:15])), (4, other), (5, None), (6, ""), (7, "word " * 60_000 + PASSAGE), (8, " ".join(reversed(w)))]
    items = [(10, PASSAGE), (10, PASSAGE), (11, None), (12, "too short"), (13, " ".join(w[:20]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "passage").collect()}
    assert {k for k, r in got.items() if r["exact"]} == {(1, 10), (1, 13), (2, 10), (2, 13), (7, 10), (7, 13)}
    assert got[4, 10]["exact"] == 0 and got[4, 10]["altered"] > 0 and got[4, 10]["changed"] == 4
    assert leaks.leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0
    assert leaks.leaks(d, "doc_id", "text", i.limit(0), "item_id", "passage").count() == 0


def test_leaks_do_not_depend_on_the_size_of_the_filters(spark, monkeypatch):
    d, i = table(spark, SMALL, "documents"), table(spark, SMALL, "eval_items")
    exact = lambda: sorted(map(str, leaks.leaks(d, "doc_id", "text", i, "item_id", "passage").filter("exact > 0").select("doc_id", "item_id", "exact").collect()))
    whole = exact()
    full = leaks.bitmap
    monkeypatch.setattr(leaks, "bitmap", lambda h: full(h, 1 << 12))  # nearly every window passes, many words count as names
    assert whole == exact()


def test_a_value_that_stands_for_two_does_not_fit(spark):
    broken = PASSAGE.replace("144", "99").replace("49", "99")  # two values of the item became one
    d = spark.createDataFrame([(1, broken), (1, broken), (None, PASSAGE)], "doc_id long, text string")
    i = spark.createDataFrame([(10, PASSAGE), (None, PASSAGE)], "item_id long, passage string")
    assert leaks.leaks(d, "doc_id", "text", i, "item_id", "passage").count() == 0


def held_out(spark):
    """(found subjects, truth) of a quarter of the labelled texts, classified among the documents."""
    examples = table(spark, "/root/testdata/sf0.01", "subject_examples")
    part = F.pmod(F.xxhash64("example_id"), F.lit(4))
    known = subjects.labelled(examples.filter(part != 0), "example_id", "text", "subjects")
    held = examples.filter(part == 0).select(F.col("example_id").alias("k"), "text")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select((F.col("doc_id") + 100_000).alias("k"), "text").unionByName(held)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "  \n "), (None, "law")], "k long, text string"))
    got = {r["key"]: set(r["subjects"]) for r in subjects.classified(docs, "k", "text", known).collect()}
    return got, {r[0]: set(r[1]) for r in examples.filter(part == 0).select("example_id", "subjects").collect()}


def test_subjects_of_held_out_examples(spark):
    got, truth = held_out(spark)
    hits = sum(len(got[k] & v) for k, v in truth.items())
    assert hits / sum(len(got[k]) for k in truth) >= 0.9 and hits / sum(map(len, truth.values())) >= 0.8
    assert got[-1] == got[-2] == got[-3] == set() and None not in got


def test_subjects_come_from_the_leaves(spark, monkeypatch):
    real = subjects._leaf_counts

    def shuffled(*args):
        counts = real(*args)
        nodes = [r[0] for r in counts.select("node").distinct().collect()]
        other = F.array(*map(F.lit, nodes))[F.pmod(F.xxhash64("node", "t"), F.lit(len(nodes))).cast("int")]
        return counts.withColumn("node", F.when(F.col("t") < 0, F.col("node")).otherwise(other)).groupBy("node", "t").agg(F.sum("n").alias("n"))

    monkeypatch.setattr(subjects, "_leaf_counts", shuffled)
    got, truth = held_out(spark)
    assert sum(len(got[k] & v) for k, v in truth.items()) <= 0.2 * sum(map(len, truth.values()))


def test_mentions_are_runs_of_one_subject():
    at = {"court": 0, "legal hold": 1, "hold": 2, "goal": 3}
    says = np.array([0, 0, -1, 1])
    n = lambda text: subjects.mentions(1, *subjects._flat(pa.array(subjects._read([text], at), pa.list_(pa.int32())))[1:], says, 2).tolist()
    assert n("the legal hold of court court, court and a goal 3 goal") == [[3, 1]]
    assert n("hold on") == n("") == n(None) == [[0, 0]]


def test_subjects_of_nothing(spark):
    examples = table(spark, SMALL, "subject_examples")
    docs = table(spark, SMALL, "documents")
    known = subjects.labelled(examples, "example_id", "text", "subjects")
    assert subjects.classified(docs.limit(0), "doc_id", "text", known).count() == 0
    none = subjects.labelled(examples.limit(0), "example_id", "text", "subjects")
    assert subjects.classified(docs, "doc_id", "text", none).filter(F.size("subjects") > 0).count() == 0
