import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.functions import lexicons as L
from siftspark.functions import text as X
from siftspark.functions.names import author_name, subreddit_name
from siftspark.operators import skew, vector
from siftspark.operators.current import current_rows, current_wide_rows
from siftspark.operators.merge import merge_upsert
from siftspark.operators.schema import evolve
from siftspark.operators.signal import signal_filter


def day(n):
    return dt.datetime(2024, 1, n)


ROWS = "id string, at timestamp, v string, extra int"


@pytest.mark.parametrize("make", [lambda d: current_rows(d, "id", "at", ["v"]), lambda d: current_wide_rows(d, "id", "at", ["v"]), lambda d: current_wide_rows(d, "id", "at", ["v"], bound=0)])
def test_current_rows(spark, make):
    df = spark.createDataFrame([("a", day(1), "old", 1), ("a", day(2), "new", 2), ("a", day(2), "new", 3), ("b", None, None, 1), ("b", day(1), "x", 1), (None, day(1), "no key", 1), ("c", None, "only", 1)], ROWS)
    assert sorted((r["id"], r["v"]) for r in make(df).collect()) == [("a", "new"), ("b", "x"), ("c", "only")]
    assert make(df.limit(0)).count() == 0


def test_merge_upsert(spark):
    old = spark.createDataFrame([("a", day(1), "old", 1), ("b", day(3), "kept", 1)], ROWS)
    new = spark.createDataFrame([("a", day(2), "new", 1), ("b", day(2), "late", 1), (None, day(2), "no key", 1)], ROWS)
    assert sorted((r["id"], r["v"]) for r in merge_upsert(old, new, "id", "at", ["v"]).collect()) == [("a", "new"), ("b", "kept")]
    assert merge_upsert(old.limit(0), new.limit(0), "id", "at", ["v"]).count() == 0


def test_names(spark):
    df = spark.createDataFrame([(" /r/SaaS ", "u/Ann"), ("R/x", " U/bob"), (" r/ y", "[deleted]"), (None, None), ("  ", "")], "s string, a string")
    got = [tuple(r) for r in df.select(subreddit_name(F.col("s")), author_name(F.col("a"))).collect()]
    assert got == [("saas", "ann"), ("x", "bob"), ("y", "[deleted]"), (None, None), ("", "")]


@pytest.mark.parametrize(("text", "score"), [("everyday", 9), ("biweekly", 8), ("infrequently", 8), ("sometimes daily", 10), (None, 4), ("", 4), ("once", 4), ("每周", 8)])
def test_first_matching_frequency(spark, text, score):
    df = spark.createDataFrame([(text,)], "f string")
    assert df.select(X.first_score(F.col("f"), L.FREQUENCY, L.FREQUENCY_DEFAULT)).head()[0] == score


POST = "id string, title string, body string, subreddit string, score int, num_comments int, upvote_ratio double, trust_level double, category string, text string"


def test_signal_filter_takes_nulls_and_empty_tables(spark):
    bad = ("So frustrated, this broken manual process", "is terrible and useless, a waste of time " * 3)
    rows = [
        ("a", None, None, None, None, None, None, None, None, "clash"),
        ("b", *bad, "r/x", 50, 50, 0.9, None, None, None),
        ("c", "demo " * 2000, "x", "x", 9, 9, 0.9, None, None, ""),
        ("business", *bad, "Startups", 14, 9, 0.9, 0.9, None, ""),
        ("talk", *bad, "x", 6, 13, 0.9, 0.9, None, ""),
        ("low", *bad, "x", 20, 10, 0.9, 0.4, None, ""),
        ("dull", "A quiet title about nothing much", "and a body that says little of it " * 2, "x", 20, 10, 0.9, None, "experimental", ""),
    ]
    df = spark.createDataFrame(rows, POST)
    got = {r["id"]: r for r in signal_filter(df).collect()}
    assert got["a"]["reason"] == "few upvotes" and got["a"]["pass_type"] is None
    assert got["b"]["reason"] is None and got["b"]["pass_type"] == "pain" and got["b"]["engagement_score"] == 1.0
    assert got["c"]["reason"] == "too long"
    assert got["business"]["reason"] == "business: few upvotes" and got["talk"]["reason"] == "discussion: few comments"
    assert got["low"]["reason"] == "low trust: little engagement"
    assert got["dull"]["reason"] == "failed: insufficient_keywords; low_emotional_intensity; low_overall_score"
    assert got["dull"]["engagement_score"] == 0.45
    assert signal_filter(df.limit(0)).count() == 0


def test_evolve_adds_only_what_is_missing(spark):
    df = evolve(spark.createDataFrame([(1, "x")], "id int, owner string"), {"owner": ("string", "none"), "n": ("int", 0)})
    assert [tuple(r) for r in df.collect()] == [(1, "x", 0)]


def _skewed(spark, n=3000):
    rows = [("hot" if i % 3 else f"k{i % 50}", i, i % 7) for i in range(n)] + [(None, -1, 1)]
    return spark.createDataFrame(rows, "key string, id int, v int")


def test_top_per_key_under_skew(spark):
    df = _skewed(spark)
    order = [F.desc("v"), F.asc("id")]
    got = sorted((r["key"], r["id"]) for r in skew.top_per_key(df, "key", order, 4, "id").collect())
    want: dict = {}
    for k, i, v in sorted(((r["key"], r["id"], r["v"]) for r in df.collect() if r["key"]), key=lambda x: (x[0], -x[2], x[1])):
        want.setdefault(k, []).append(i)
    assert got == sorted((k, i) for k, ids in want.items() for i in ids[:4])
    assert skew.top_per_key(df.limit(0), "key", order, 4, "id").count() == 0


def test_placement_splits_and_bounds_heavy_keys(spark):
    place = skew.placement(_skewed(spark), "key", tasks=8)
    assert len(place.shards["hot"]) > 4 and len(place.shards) <= 32


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_load(spark, how):
    df = _skewed(spark)
    other = spark.createDataFrame([("hot", 1.5), ("hot", 2.5), ("k3", 3.5), ("absent", 4.5), (None, 5.5)], "key string, w double")
    got = sorted(map(str, skew.join_by_load(df, other, "key", "id", how).select("key", "id", "w").collect()))
    assert got == sorted(map(str, df.join(other, "key", how).select("key", "id", "w").collect()))


def test_exact_vector_search(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    x[7] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [0.0] * 8), (102, [1.0]), (103, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query"], r["id"]) for r in vector.search(df.filter("id % 5 = 0"), df, 8, 3).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, 60, 5):
        c = (u @ u[q]).round(12)
        want |= {(q, int(i)) for i in sorted((i for i in range(60) if i != q), key=lambda i: (-c[i], i))[:3]}
    assert got == want
    assert vector.search(df.limit(0), df, 8, 3).count() == 0


@pytest.mark.parametrize("block", [3, 20_000])
def test_pairs_in_groups_are_whole_whatever_the_parts(spark, block):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 4)).astype(np.float32)
    x[7] = 2 * x[20]
    groups = [None if i % 50 == 9 else 1 if i < 300 else i % 40 for i in range(400)]
    rows = spark.createDataFrame([(g, i, v.tolist(), i % 20 == 0) for i, (g, v) in enumerate(zip(groups, x))], "g long, id long, v array<float>, asks boolean")
    got = {(r["a"], r["b"]): r["cosine"] for r in vector.pairs_in_groups(rows, "g", 4, tasks=5, block=block).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(a, b): u[a] @ u[b] for a in range(0, 400, 20) for b in range(400) if a != b and groups[a] is not None and groups[a] == groups[b]}
    assert got.keys() == want.keys() and got[20, 7] == 1.0
    assert all(abs(got[k] - c) < 6e-7 and got[k] == round(got[k], 6) for k, c in want.items())
    assert not vector.pairs_in_groups(rows.limit(0), "g", 4).head(1)


def test_cut_leaves_no_shuffle_files(spark):
    from siftspark.plans.scratch import cut

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    left = files() - before
    assert not left and kept.count() == 7


def test_many_repeated_keys_do_not_group_the_whole_table(spark):
    rows = [(f"k{i}", day(1), f"v{i}", 1) for i in range(400)] + [(f"k{i}", day(2), "new", 1) for i in range(20)]
    got = current_wide_rows(spark.createDataFrame(rows, ROWS), "id", "at", ["v"], bound=5)
    assert sorted((r["id"], r["v"]) for r in got.collect()) == sorted((f"k{i}", "new" if i < 20 else f"v{i}") for i in range(400))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
