import numpy as np
import pytest

from siftspark.llm import density, vectors
from siftspark.llm.hashing import Hashing, bucket_keys

DIM = 16
SCHEMA = "id long, v array<float>, at int, cell string"


def grouped(seed=0, groups=60, size=12, lone=300, noise=0.12):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((groups, DIM))
    c /= np.linalg.norm(c, axis=1)[:, None]
    x = np.repeat(c, size, axis=0) + noise * rng.standard_normal((groups * size, DIM))
    return np.concatenate([x, rng.standard_normal((lone, DIM))]).astype(np.float32)


def frame(spark, x, more=()):
    rows = [(i, [float(v) for v in r], 1, "clash") for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *more], SCHEMA)


def cosines(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return (u @ u.T).round(12)


def brute_nearest(x, k, floor):
    c = cosines(x)
    out = set()
    for q in range(len(x)):
        near = [i for i in np.flatnonzero(c[q] >= floor).tolist() if i != q]
        out |= {(q, i) for i in sorted(near, key=lambda i: (-c[q, i], i))[:k]}
    return out


def brute_groups(x, floor):
    c = cosines(x)
    label = list(range(len(x)))
    for a, b in zip(*np.nonzero(c >= floor)):
        la, lb = label[a], label[b]
        if la != lb:
            label = [min(la, lb) if y in (la, lb) else y for y in label]
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if label[i] == label[j]}


def routed(spark, df, n, share=vectors.SHARE, cell_rows=vectors.CELL_ROWS):
    return vectors.route(vectors.usable_vectors(df, "id", "v", "at", DIM), DIM, n, share, cell_rows)


BAD = [(9001, None, 1, ""), (9002, [0.0] * DIM, 1, ""), (9003, [1.0], 1, ""), (9004, [float("nan")] * DIM, 1, ""), (9005, [float("inf")] * DIM, 1, ""), (9006, [None] * DIM, 1, ""), (None, [1.0] * DIM, 1, "")]


def test_unusable_vectors_and_stale_rows_are_left_out(spark):
    x = grouped(groups=2, size=3, lone=4)
    stale = [(0, [5.0] * DIM, 0, ""), (1, [float(v) for v in x[1]], 1, "")]
    got = vectors.usable_vectors(frame(spark, x, BAD + stale), "id", "v", "at", DIM).collect()
    assert sorted(r["id"] for r in got) == list(range(len(x)))
    assert np.array_equal(np.frombuffer(next(r["v"] for r in got if r["id"] == 0), np.float32), x[0])


def test_bucket_keys_start_with_the_own_bucket_and_differ():
    x = grouped()
    keys = bucket_keys(x, 0, Hashing(1, 6, 1.5, 15))
    assert keys.shape == (len(x), 16)
    assert all(len(set(r)) == 16 for r in keys.tolist())
    assert np.array_equal(keys[:, :1], bucket_keys(x, 0, Hashing(1, 6, 1.5, 0)))


def test_nearest_with_copies_and_ties(spark):
    x = grouped()
    x[1:260:2] = x[1]  # a large group of copies
    x[3] = 2 * x[1]  # and a scaled one
    got = {(r["a"], r["b"]) for r in vectors.nearest(routed(spark, frame(spark, x, BAD), len(x)), DIM, 5, 0.85).collect()}
    assert got == brute_nearest(x, 5, 0.85)


def test_nearest_across_cells_hot_cells_and_shards(spark):
    x = grouped(groups=100, lone=800)
    x[:600] = x[0] + 0.01 * np.random.default_rng(1).standard_normal((600, DIM))  # a dense third that no coarse hash splits
    want = brute_nearest(x, 5, 0.85)
    got = {(r["a"], r["b"]) for r in vectors.nearest(routed(spark, frame(spark, x), len(x), share=150, cell_rows=150), DIM, 5, 0.85).collect()}
    assert len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("cell_rows", [150, 10**6])
def test_no_wave_sends_more_than_its_share_however_many_visits_there_are(spark, cell_rows):
    x = grouped(groups=100, lone=1200)
    x[:600] = x[0] + 0.01 * np.random.default_rng(1).standard_normal((600, DIM))
    r = routed(spark, frame(spark, x), len(x), share=150, cell_rows=cell_rows)
    sent = [vectors._sent(r.vectors, r, DIM, wave).count() for wave in range(r.waves)]
    assert sum(sent) > 1.5 * vectors.WAVE * len(x) and max(sent) <= 1.5 * vectors.WAVE * len(x)
    got = {(p["a"], p["b"]) for p in vectors.nearest(r, DIM, 5, 0.85).collect()}
    want = brute_nearest(x, 5, 0.85)
    assert len(got & want) >= 0.98 * len(want)


def test_with_cells_enough_for_all_tasks_a_wave_sends_each_row_about_once(spark):
    x = grouped(groups=100, lone=1200)
    r = routed(spark, frame(spark, x), len(x), share=20)
    sent = [vectors._sent(r.vectors, r, DIM, wave).count() for wave in range(r.waves)]
    assert sum(sent) > 2 * vectors.WAVE * len(x) and max(sent) <= 1.3 * len(x)
    got = {(p["a"], p["b"]) for p in density.pairs_of_groups(density.tops(r, DIM, 0.85), "label", "id", "a", "b").collect()}
    want = brute_groups(x, 0.85)
    assert len(got & want) >= 0.98 * len(want) and got <= want


@pytest.mark.parametrize("shards", [{}, {3: (2, 3), 20: (1, 2)}])
def test_waves_together_make_all_visits(shards):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, DIM))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    directions, _ = vectors.projections(DIM, 1000, 5, 1.0, 7)
    r = vectors.Routing(directions, np.zeros(5, np.float32), shards)
    ids = np.arange(len(x)) * 7
    blocks = lambda among=None: sorted(zip(*(c.tolist() for c in r.blocks(*r.visits(x, among), ids))))
    parts = [np.array(part) for part in ([0, 16, 8], [3, 20], sorted(set(range(32)) - {0, 3, 8, 16, 20}))]
    assert sorted(v for part in parts for v in blocks(part)) == blocks()


def test_empty(spark):
    r = routed(spark, frame(spark, grouped()).limit(0), 0)
    assert vectors.nearest(r, DIM, 5, 0.85).count() == 0
    tree, labels = density.spanning_tree(density.reachability_edges(r, DIM, 2, 0.85))
    assert tree.count() == 0 and labels.count() == 0


def test_groups_are_the_components_of_the_link_graph(spark):
    x = grouped(noise=0.2)
    x[5:200:7] = x[5]
    r = routed(spark, frame(spark, x, BAD), len(x))
    tree, labels = density.spanning_tree(density.reachability_edges(r, DIM, 2, 0.85))
    pairs = density.pairs_of_groups(density.with_copies(labels, r), "label", "id", "a", "b")
    assert {(p["a"], p["b"]) for p in pairs.collect()} == brute_groups(x, 0.85)
    assert tree.count() == labels.count() - labels.select("label").distinct().count()


def test_spanning_forest_has_the_greatest_weight():
    rng = np.random.default_rng(2)
    n = 40
    a, b = np.triu_indices(n, 1)
    w = rng.random(len(a)).round(2)
    got = w[vectors.spanning_forest(n, a, b, w)].sum()
    root, want = list(range(n)), 0.0
    find = lambda v: v if root[v] == v else find(root[v])
    for e in np.argsort(-w, kind="stable"):
        p, q = find(a[e]), find(b[e])
        if p != q:
            root[p] = q
            want += w[e]
    assert got == pytest.approx(want)


def test_clusters_are_dense_groups_with_exemplars(spark):
    x = grouped(groups=10, size=20, lone=50, noise=0.05)
    x[0:3] = x[0]
    found, members = density.clusters(routed(spark, frame(spark, x, BAD), len(x)), DIM, 3, 0.85)
    truth = {i: i // 20 for i in range(200)}
    got: dict = {}
    for r in members.collect():
        got.setdefault(r["cluster_id"], set()).add(r["id"])
    # every cluster lies in one planted group, and every planted group is covered for the most part
    assert all(len({truth.get(i, -i - 1) for i in ids}) == 1 for ids in got.values())
    covered = {i for ids in got.values() for i in ids}
    assert len(covered & set(truth)) >= 180
    for r in found.collect():
        assert r["size"] == len(got[r["cluster_id"]]) >= 5
        assert 1 <= len(r["exemplars"]) <= 5 and set(r["exemplars"]) <= got[r["cluster_id"]]


def test_condensed_prefers_stable_children():
    # two tight blocks, joined loosely
    ids = np.arange(12)
    a = np.array([0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 5])
    b = a + 1
    w = np.array([0.99] * 10 + [0.86])
    out = density.condensed(ids, np.ones(12, np.int64), a, b, w, 0.85, 5, 2)
    assert sorted(sorted(m.tolist()) for m, _, _ in out) == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]]
    assert density.condensed(ids[:3], np.ones(3, np.int64), a[:2], b[:2], w[:2], 0.85, 5, 2) == []


def test_large_components_are_taken_apart_at_finer_levels(spark, monkeypatch):
    monkeypatch.setattr(density, "COMPONENT", 15)
    x = grouped(groups=6, size=30, lone=10, noise=0.1)
    found, members = density.clusters(routed(spark, frame(spark, x), len(x)), DIM, 2, 0.85)
    assert found.count() > 0 and members.groupBy("id").count().filter("count > 1").count() == 0


def test_clusters_do_not_depend_on_the_size_of_a_component(spark, monkeypatch):
    x = grouped(groups=3, size=60, lone=10, noise=0.18)
    r = routed(spark, frame(spark, x), len(x))
    results = []
    for most in (10**6, 15):
        monkeypatch.setattr(density, "COMPONENT", most)
        found, members = density.clusters(r, DIM, 2, 0.85)
        results.append((sorted(map(str, found.collect())), sorted(map(tuple, members.select("id", "cluster_id").collect()))))
    assert results[0] == results[1] and results[0][1]
