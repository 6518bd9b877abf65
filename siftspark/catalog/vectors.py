"""Vector search and cluster geometry."""

from pyspark.sql import functions as F

from siftspark.catalog.base import query
from siftspark.operators import vector as V

DIM = 64
_OK = "embedding_vector IS NOT NULL AND len(embedding_vector) = 64 AND len(list_filter(embedding_vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding_vector, lambda x: x <> 0)) > 0"
_V = f"v AS (SELECT pain_event_id AS id, CAST(embedding_vector AS DOUBLE[]) AS v FROM emb_now WHERE {_OK})"
_TOP = "SELECT query, id, round(c, 6) AS cosine FROM (SELECT q.id AS query, r.id, list_cosine_similarity(q.v, r.v) AS c, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, r.v), 12) DESC, r.id) AS n FROM v q JOIN {rows} r ON r.id <> q.id WHERE q.id % 20 = 0) WHERE n <= {k}"


def _vectors(t):
    e = t.embeddings("embedding_vector")
    return e.select(F.col("pain_event_id").alias("id"), F.col("embedding_vector").alias("v"))


def cosine(a, b):
    """The cosine of two array columns of equal length, summed in double."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _top(t, rows, k, floor=-1.0):
    found = V.search(_vectors(t).filter("id % 20 = 0"), rows, DIM, k, floor)
    return found.select("query", "id", F.round("cosine", 6).alias("cosine"))


@query("j16_knn_join", f"WITH {_V} {_TOP.format(rows='v', k=10)}")
def j16(t):
    """The 10 most similar events of every event whose id is divisible by 20, against all."""
    return _top(t, _vectors(t), 10)


@query("v05_threshold_topk", f"WITH {_V} SELECT * FROM ({_TOP.format(rows='v', k=10)}) WHERE cosine >= 0.85")
def v05(t):
    return _top(t, _vectors(t), 10, 0.85)


@query("v06_knn_with_filter", f"WITH {_V}, active AS (SELECT v.* FROM v JOIN events_now e ON e.id = v.id WHERE e.lifecycle_stage = 'active') {_TOP.format(rows='active', k=10)}")
def v06(t):
    active = t.events("lifecycle_stage").filter("lifecycle_stage = 'active'").select("id")
    return _top(t, _vectors(t).join(active, "id", "left_semi"), 10)


_CV = f"{_V}, c AS (SELECT e.cluster_id, v.id, v.v FROM v JOIN events_now e ON e.id = v.id WHERE e.cluster_id IS NOT NULL)"
_MEAN = "m AS (SELECT cluster_id, d, avg(x) AS mean FROM (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM c) GROUP BY 1, 2)"


def _clustered(t):
    e = t.events("cluster_id").filter("cluster_id IS NOT NULL").select("id", "cluster_id")
    return _vectors(t).filter(V.usable(F.col("v"), DIM)).join(e, "id")


@query("g25_centroid", f"WITH {_CV}, {_MEAN} SELECT cluster_id, CAST(d AS INT) AS d, round(mean, 6) AS mean FROM m")
def g25(t):
    return V.centroids(_clustered(t), "cluster_id", "v").select("cluster_id", "d", F.round("mean", 6).alias("mean"))


@query("g26_cohesion", f"WITH {_CV}, {_MEAN}, l AS (SELECT cluster_id, list(mean ORDER BY d) AS m FROM m GROUP BY 1) SELECT c.cluster_id, round(avg(list_cosine_similarity(c.v, l.m)), 6) AS cohesion FROM c JOIN l USING (cluster_id) GROUP BY 1")
def g26(t):
    """Mean cosine of the members with their cluster's centroid."""
    rows = _clustered(t)
    m = V.centroid_vectors(rows, "cluster_id", "v").withColumnRenamed("v", "m")
    cos = cosine(F.col("v"), F.col("m"))
    return rows.join(m, "cluster_id").groupBy("cluster_id").agg(F.round(F.avg(cos), 6).alias("cohesion"))


_VOTE = f"""WITH {_V}, active AS (SELECT v.*, e.cluster_id FROM v JOIN events_now e ON e.id = v.id WHERE e.lifecycle_stage = 'active' AND e.cluster_id IS NOT NULL),
q AS (SELECT v.* FROM v JOIN events_now e ON e.id = v.id WHERE e.cluster_id IS NULL AND e.id % 20 = 0),
near AS (SELECT q.id AS query, a.cluster_id, round(list_cosine_similarity(q.v, a.v), 12) AS c, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, a.v), 12) DESC, a.id) AS n FROM q JOIN active a ON a.id <> q.id),
votes AS (SELECT query, cluster_id, avg(c) + ln(count(*) + 1) / 10 AS s FROM near WHERE n <= 20 GROUP BY 1, 2)
SELECT query AS id, arg_min(cluster_id, struct_pack(a := -round(s, 9), b := cluster_id)) AS cluster_id FROM votes GROUP BY 1 HAVING max(round(s, 9)) >= 0.75"""


@query("st02_neighbour_vote", _VOTE)
def st02(t):
    """For every unclustered event whose id is divisible by 20 the cluster its 20 nearest active events vote for."""
    e = t.events("lifecycle_stage", "cluster_id")
    active = e.filter("lifecycle_stage = 'active' AND cluster_id IS NOT NULL").select("id", "cluster_id")
    asked = e.filter("cluster_id IS NULL AND id % 20 = 0").select("id")
    near = V.search(_vectors(t).join(asked, "id", "left_semi"), _vectors(t).join(active, "id", "left_semi"), DIM, 20)
    votes = near.join(active, "id").groupBy("query", "cluster_id").agg(F.round(F.avg("cosine") + F.log(F.count(F.lit(1)) + 1) / 10, 9).alias("s"))
    best = votes.groupBy(F.col("query").alias("id")).agg(F.max(F.struct("s", (-F.col("cluster_id")).alias("c"))).alias("m"))
    return best.filter(F.col("m.s") >= 0.75).select("id", (-F.col("m.c")).alias("cluster_id"))


@query("st03_formation_neighbours", f"""WITH {_V}, orphan AS (SELECT v.*, e.extracted_at FROM v JOIN events_now e ON e.id = v.id WHERE e.cluster_id IS NULL AND e.extracted_at IS NOT NULL),
near AS (SELECT q.id, r.id AS neighbour, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, r.v), 12) DESC, r.id) AS n, r.extracted_at >= q.extracted_at - INTERVAL 24 HOUR AS recent, list_cosine_similarity(q.v, r.v) AS c FROM orphan q JOIN orphan r ON r.id <> q.id WHERE q.id % 20 = 0)
SELECT id, count(*) AS neighbours FROM near WHERE n <= 50 AND c >= 0.7 AND recent GROUP BY 1""")
def st03(t):
    """Of every unclustered event whose id is divisible by 20: how many of its 50 nearest unclustered events are similar and no more than 24 hours older."""
    at = t.events("cluster_id", "extracted_at").filter("cluster_id IS NULL AND extracted_at IS NOT NULL").select("id", "extracted_at")
    orphans = _vectors(t).join(at, "id", "left_semi")
    near = V.search(orphans.filter("id % 20 = 0"), orphans, DIM, 50, 0.7)
    both = near.join(at, "id").join(at.select(F.col("id").alias("query"), F.col("extracted_at").alias("asked")), "query")
    recent = both.filter("extracted_at >= asked - INTERVAL 24 HOUR")
    return recent.groupBy(F.col("query").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"))


