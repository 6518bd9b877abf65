"""Growing clusters: similar ones, equal sets, the flow of proposed groups, online assignment as a batch and as a stream."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.operators import clusters as C
from siftspark.operators import sinks, vector
from siftspark.streaming import events as S


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


CLUSTERS = "id long, v array<double>, size int, created_at timestamp_ntz, extra string"


def test_the_newest_recent_cluster_counts_not_the_most_similar(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0], 9, day(10), ""), (2, [1.0, 0.5], 9, day(12), ""), (3, [1.0, 0.0], 2, day(14), ""), (4, [1.0, 0.0], 9, day(2), ""), (5, [1.0, 0.6], 9, day(12), ""), (6, [0.0, 1.0], 9, None, ""), (7, None, 9, day(14), "")], CLUSTERS)
    new = spark.createDataFrame([(100, [1.0, 0.0]), (101, [-1.0, 0.0]), (102, None), (2, [1.0, 0.0])], "grp long, v array<double>")
    got = {r["grp"]: r["cluster_id"] for r in C.similar_existing(new, old, 2).collect()}
    assert got == {100: 2, 2: 5}
    assert C.similar_existing(new.limit(0), old, 2).count() == 0 and C.similar_existing(new, old.limit(0), 2).count() == 0


def test_equal_sets(spark):
    rows = [(1, 5), (1, 6), (1, 6), (2, 6), (2, 5), (3, 5), (4, None), (None, 5)]
    df = spark.createDataFrame(rows, "g long, m long")
    got = sorted((r["left_group"], r["right_group"]) for r in C.equal_sets(df, df, "g", "m").filter("left_group < right_group").collect())
    assert got == [(1, 2)]


def test_flow(spark):
    groups = spark.createDataFrame([(g, 10 * g + i, [1.0, 0.0] if g != 4 else [0.0, 1.0]) for g in (1, 2, 4, 5) for i in range(4)] + [(3, 30, [1.0, 0.0]), (5, 51, None)], "grp long, id long, v array<double>")
    groups = groups.withColumn("v", F.when(F.col("grp") == 5, F.array(F.lit(-1.0), F.lit(0.0))).otherwise(F.col("v")))
    members = spark.createDataFrame([(77, 10 + i) for i in range(4)] + [(88, 99)], "cluster_id long, id long")
    old = spark.createDataFrame([(88, [1.0, 0.1], 9, day(10), "")], CLUSTERS)
    valid = spark.createDataFrame([(4,), (4,)], "grp long")
    got = {r["grp"]: (r["action"], r["cluster_id"]) for r in C.flow(groups, members, old, valid, 2).collect()}
    assert got == {1: ("skip", 77), 2: ("merge", 88), 3: ("small", None), 4: ("create", None), 5: ("reject", None)}


EVENT = "id long, v array<double>, at timestamp"


def test_batch_assignment(spark):
    active = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 10), (2, [1.0, 0.1, 0.0], 10), (3, [0.0, 1.0, 0.0], 20)], "id long, v array<double>, cluster_id long")
    orphans = spark.createDataFrame([(i, [0.0, 0.01 * i, 1.0], day(5, i % 24)) for i in range(40, 44)] + [(50, [0.0, 0.0, 1.0], day(1)), (60, [0.0, 0.0, -1.0], day(5))], EVENT)
    events = spark.createDataFrame([(100, [1.0, 0.05, 0.0], day(5)), (101, [0.0, 0.0, 1.0], day(5, 10)), (102, [0.0, 0.1, 1.0], day(5, 10)), (103, None, day(5)), (104, [0.0, 0.0, -1.0], day(5))], EVENT)
    got: dict = {}
    for r in C.assigned(events, active, orphans, 3).collect():
        got.setdefault((r["id"], r["action"], r["cluster_id"]), set()).add(r["member"])
    # 101 and 102 claim common orphans, so the smaller one founds
    assert got == {(100, "merge", 10): {100}, (101, "create", 101): {101, 40, 41, 42}, (102, "orphan", None): {None}, (103, "orphan", None): {None}, (104, "orphan", None): {None}}
    assert C.assigned(events.limit(0), active, orphans, 3).count() == 0
    assert {r["action"] for r in C.assigned(events, active.limit(0), orphans.limit(0), 3).collect()} == {"orphan"}


def test_assignment_as_a_stream(spark, tmp_path):
    batches = [[(1, [1.0, 0.0], day(1)), (2, [1.0, 0.01], day(1)), (3, [1.0, 0.02], day(1)), (4, [0.0, 1.0], day(1))], [(5, [1.0, 0.03], day(1, 5)), (6, None, day(1))], [(7, [1.0, 0.0], day(1, 6)), (5, [1.0, 0.03], day(1, 5))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema)
        S.assignment_stream(stream, str(tmp_path / "out"), 2, str(tmp_path / "cp")).awaitTermination()
        state = {r["id"]: r["cluster_id"] for r in sinks.read_folder(spark, str(tmp_path / "out")).collect()}
        if i == 0:
            assert state == {1: None, 2: None, 3: None, 4: None}
        if i == 1:  # the fifth finds three orphans and founds
            assert state == {1: 5, 2: 5, 3: 5, 4: None, 5: 5, 6: None}
    assert state == {1: 5, 2: 5, 3: 5, 4: None, 5: 5, 6: None, 7: 5}


@pytest.mark.parametrize("block", [10_000, 7])
def test_search_by_broadcast_and_by_grid(spark, block):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 8)).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None)], "id long, v array<double>")
    got = {(r["query"], r["id"]) for r in vector.search(df.filter("id % 3 = 0"), df, 8, 4, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, 80, 3):
        c = (u @ u[q]).round(12)
        want |= {(q, int(i)) for i in sorted((i for i in range(80) if i != q), key=lambda i: (-c[i], i))[:4]}
    assert got == want
    ranked = df.withColumn("rank", 1000 - F.col("id"))
    first = {r["query"]: r["id"] for r in vector.first_similar(df.filter("id % 3 = 0"), ranked, 8, 0.5, block=block).collect()}
    for q in range(0, 80, 3):
        good = [i for i in range(80) if i != q and (u @ u[q]).round(12)[i] >= 0.5]
        assert first.get(q) == (max(good) if good else None)


def test_a_status_update_without_a_match_raises(spark):
    from siftspark.catalog.rest import updated_status

    df = spark.createDataFrame([(1, "a", None), (2, None, "x")], "id int, cluster_name string, alignment_status string")
    new = spark.createDataFrame([("a", "done")], "cluster_name string, new string")
    assert {r["id"]: r["alignment_status"] for r in updated_status(df, new).collect()} == {1: "done", 2: "x"}
    with pytest.raises(ValueError, match="no cluster is named b"):
        updated_status(df, spark.createDataFrame([("b", "done")], "cluster_name string, new string"))
