"""Clusters over time: similar ones, merging, online assignment, summaries, snapshots and changes."""

from pyspark.sql import functions as F

from siftspark.catalog.aggregates import _freq_sql, cluster_metrics
from siftspark.catalog.base import query
from siftspark.catalog.lifecycle import _AS_OF, AS_OF
from siftspark.catalog.vectors import _CV, _MEAN, _V, DIM, _clustered, _vectors, cosine
from siftspark.catalog.windows import _SNAPSHOTS, snapshots
from siftspark.functions import lexicons as L
from siftspark.functions import text as X
from siftspark.operators import clusters as C
from siftspark.operators import vector as V
from siftspark.operators.skew import top_per_key
from siftspark.plans.scratch import cut

_CENTRES = f"{_CV}, {_MEAN}, l AS (SELECT cluster_id AS id, list(mean ORDER BY d) AS v FROM m GROUP BY 1), recent AS (SELECT l.id, l.v, k.created_at FROM l JOIN clusters k ON k.id = l.id WHERE k.cluster_size >= 3 AND k.created_at > (SELECT max(created_at) FROM clusters JOIN l USING (id)) - INTERVAL 7 DAY)"


def _centres(t):
    """(id, v, size, created_at) of the clusters with vectors."""
    about = t.clusters.select("id", F.col("cluster_size").alias("size"), "created_at")
    return cut(V.centroid_vectors(_clustered(t), "cluster_id", "v").withColumnRenamed("cluster_id", "id").join(about, "id"))


@query("j17_similar_centroids", f"""WITH {_CENTRES}
SELECT id, other FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id) AS r FROM l a JOIN recent b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.75) WHERE r = 1""")
def j17(t):
    """Of every cluster the newest other one of the last 7 days, of at least 3 events, whose centroid has a cosine of at least 0.75 with its own."""
    m = _centres(t)
    return C.similar_existing(m.select(F.col("id").alias("grp"), "v"), m, DIM).select(F.col("grp").alias("id"), F.col("cluster_id").alias("other"))


#: Proposed groups: unclustered events of a post, and the members of every fifth cluster again, as a second run would propose them.
_GROUPS = """p AS (SELECT e.id, e.post_id, e.cluster_id, e.emotional_signal, e.problem FROM events_now e),
posted AS (SELECT post_id, min(id) AS grp FROM p WHERE cluster_id IS NULL AND post_id IS NOT NULL GROUP BY 1),
grp AS (SELECT posted.grp, p.id, p.emotional_signal, p.problem FROM p JOIN posted USING (post_id) WHERE p.cluster_id IS NULL UNION ALL SELECT -cluster_id, id, emotional_signal, problem FROM p WHERE cluster_id % 5 = 0)"""
_LIKE = f"""gm AS (SELECT g, d, avg(x) AS mean FROM (SELECT grp.grp AS g, unnest(v.v) AS x, generate_subscripts(v.v, 1) - 1 AS d FROM grp JOIN v USING (id)) GROUP BY 1, 2),
gv AS (SELECT g, list(mean ORDER BY d) AS v FROM gm GROUP BY 1),
large AS (SELECT grp FROM grp GROUP BY 1 HAVING count(*) >= 4),
likes AS (SELECT g AS grp, id AS cluster_id, c FROM (SELECT a.g, b.id, list_cosine_similarity(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.g ORDER BY b.created_at DESC, b.id) AS r FROM gv a JOIN large ON large.grp = a.g JOIN recent b ON b.id <> a.g WHERE list_cosine_similarity(a.v, b.v) >= 0.75) WHERE r = 1)"""


def _groups(t):
    """(grp, id, emotional_signal, problem)."""
    e = t.events("post_id", "cluster_id", "emotional_signal", "problem").select("id", "post_id", "cluster_id", "emotional_signal", "problem")
    free = e.filter("cluster_id IS NULL AND post_id IS NOT NULL")
    of = free.groupBy("post_id").agg(F.min("id").alias("grp"))
    new = free.join(of, "post_id").select("grp", "id", "emotional_signal", "problem")
    again = e.filter("cluster_id % 5 = 0").select((-F.col("cluster_id")).alias("grp"), "id", "emotional_signal", "problem")
    return cut(new.unionByName(again))


def _with_vectors(t, groups):
    return groups.join(_vectors(t), "id", "left")


@query("v10_similar_existing", f"WITH {_CENTRES}, {_GROUPS}, {_LIKE} SELECT grp, cluster_id, round(c, 6) AS cosine FROM likes")
def v10(t):
    """Of every proposed group of at least four events the newest recent cluster with a similar centroid."""
    g = _with_vectors(t, _groups(t))
    large = g.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select("grp")
    rows = g.filter(V.usable(F.col("v"), DIM)).join(large, "grp", "left_semi")
    return C.similar_existing(V.centroid_vectors(rows, "grp", "v"), _centres(t), DIM).withColumn("cosine", F.round("cosine", 6))


@query("v11_incremental_merge", """WITH n AS (SELECT cluster_id, id, problem, false AS new FROM events_now WHERE cluster_id IS NOT NULL UNION ALL SELECT k.cluster_id, e.id, e.problem, true FROM events_now e JOIN (SELECT post_id, min(cluster_id) AS cluster_id FROM events_now WHERE cluster_id IS NOT NULL AND post_id IS NOT NULL GROUP BY 1) k ON k.post_id = e.post_id WHERE e.cluster_id IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS place FROM n)
SELECT cluster_id, count(*) AS size, count(*) FILTER (WHERE new) AS added, string_agg(CASE WHEN place <= 20 THEN substr(problem, 1, 40) END, ' | ' ORDER BY id) AS summary FROM r GROUP BY 1""")
def v11(t):
    """Unclustered events join the least cluster of their post: size, events added and the summary of the first 20 members of every cluster."""
    e = t.events("cluster_id", "post_id", "problem").select("id", "cluster_id", "post_id", "problem")
    old = e.filter("cluster_id IS NOT NULL")
    to = old.filter("post_id IS NOT NULL").groupBy("post_id").agg(F.min("cluster_id").alias("to"))
    added = e.filter("cluster_id IS NULL").join(to, "post_id").select(F.col("to").alias("cluster_id"), "id")
    m = cut(C.merged(old, added))
    sizes = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.count_if("new").alias("added"))
    first = top_per_key(m.select("cluster_id", "id"), "cluster_id", [F.asc("id")], 20, "id").join(e.select("id", "problem"), "id")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("id", F.substring("problem", 1, 40).alias("p")))), lambda s: s["p"])
    text = first.filter("problem IS NOT NULL").groupBy("cluster_id").agg(F.array_join(parts, " | ").alias("summary"))
    return sizes.join(text, "cluster_id", "left").select("cluster_id", "size", "added", "summary")


@query("v12_cluster_flow", f"""WITH {_CENTRES}, {_GROUPS}, {_LIKE}, s AS (SELECT grp, count(*) AS n, list(id ORDER BY id) AS ids FROM grp GROUP BY 1),
old AS (SELECT cluster_id, list(id ORDER BY id) AS ids FROM events_now WHERE cluster_id IS NOT NULL GROUP BY 1),
same AS (SELECT s.grp, min(old.cluster_id) AS same FROM s JOIN old ON old.ids = s.ids GROUP BY 1),
firsts AS (SELECT grp, emotional_signal FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS r FROM grp) WHERE r <= 20),
ok AS (SELECT grp FROM (SELECT grp, max(k) AS k, sum(k) AS n FROM (SELECT grp, coalesce(emotional_signal, '') AS s, count(*) AS k FROM firsts GROUP BY 1, 2) GROUP BY 1) WHERE k >= 0.5 * n)
SELECT s.grp, s.n, CASE WHEN n < 4 THEN 'small' WHEN same IS NOT NULL THEN 'skip' WHEN likes.cluster_id IS NOT NULL THEN 'merge' WHEN ok.grp IS NOT NULL THEN 'create' ELSE 'reject' END AS action, CASE WHEN n >= 4 THEN coalesce(same, likes.cluster_id) END AS cluster_id
FROM s LEFT JOIN same USING (grp) LEFT JOIN likes ON likes.grp = s.grp LEFT JOIN ok ON ok.grp = s.grp""")
def v12(t):
    """What becomes of every proposed group; the stand-in for the model's validation asks for one emotional signal in half of the first 20 events."""
    g = _groups(t)
    firsts = top_per_key(g.select("grp", "id", "emotional_signal"), "grp", [F.asc("id")], 20, "id")
    k = firsts.groupBy("grp", F.coalesce("emotional_signal", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("k"))
    valid = k.groupBy("grp").agg(F.max("k").alias("k"), F.sum("k").alias("n")).filter("k >= 0.5 * n").select("grp")
    members = t.events("cluster_id").filter("cluster_id IS NOT NULL").select("cluster_id", "id")
    return C.flow(_with_vectors(t, g).select("grp", "id", "v"), members, _centres(t), valid, DIM)


_ONLINE = f"""{_V}, active AS (SELECT v.*, e.cluster_id FROM v JOIN events_now e ON e.id = v.id WHERE e.lifecycle_stage = 'active' AND e.cluster_id IS NOT NULL),
ev AS (SELECT id, extracted_at FROM events_now WHERE cluster_id IS NULL AND id % 20 = 0),
orphan AS (SELECT v.*, e.extracted_at FROM v JOIN events_now e ON e.id = v.id WHERE e.cluster_id IS NULL AND e.lifecycle_stage = 'orphan'),
q AS (SELECT v.*, ev.extracted_at FROM v JOIN ev USING (id)),
near AS (SELECT q.id AS query, a.cluster_id, round(list_cosine_similarity(q.v, a.v), 12) AS c, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, a.v), 12) DESC, a.id) AS n FROM q JOIN active a ON a.id <> q.id),
votes AS (SELECT query, cluster_id, round(avg(c) + ln(count(*) + 1) / 10, 9) AS s FROM near WHERE n <= 20 GROUP BY 1, 2),
joined AS (SELECT query AS id, arg_min(cluster_id, struct_pack(a := -s, b := cluster_id)) AS cluster_id FROM votes GROUP BY 1 HAVING max(s) >= 0.75),
near2 AS (SELECT q.id AS founder, r.id AS member, round(list_cosine_similarity(q.v, r.v), 12) AS c, q.extracted_at AS asked, r.extracted_at AS seen, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, r.v), 12) DESC, r.id) AS n FROM q JOIN orphan r ON r.id <> q.id WHERE q.id NOT IN (SELECT id FROM joined)),
three AS (SELECT founder, member FROM (SELECT *, row_number() OVER (PARTITION BY founder ORDER BY c DESC, member) AS r FROM near2 WHERE n <= 50 AND c >= 0.7 AND seen >= asked - INTERVAL 24 HOUR) WHERE r <= 3),
full3 AS (SELECT founder FROM three GROUP BY 1 HAVING count(*) = 3),
claims AS (SELECT founder, member FROM three WHERE founder IN (SELECT founder FROM full3) UNION ALL SELECT founder, founder FROM full3),
made AS (SELECT founder, member FROM claims WHERE founder NOT IN (SELECT c.founder FROM claims c JOIN (SELECT member, min(founder) AS least FROM claims GROUP BY 1) f USING (member) WHERE c.founder <> f.least)),
decided AS (SELECT id, 'merge' AS action, cluster_id, id AS member FROM joined UNION ALL SELECT founder, 'create', founder, member FROM made UNION ALL SELECT id, 'orphan', NULL, NULL FROM ev WHERE id NOT IN (SELECT id FROM joined) AND id NOT IN (SELECT founder FROM made))"""


def _decided(t):
    e = t.events("lifecycle_stage", "cluster_id", "extracted_at").select("id", "lifecycle_stage", "cluster_id", F.col("extracted_at").alias("at"))
    v = _vectors(t)
    active = v.join(e.filter("lifecycle_stage = 'active' AND cluster_id IS NOT NULL").select("id", "cluster_id"), "id")
    orphans = v.join(e.filter("cluster_id IS NULL AND lifecycle_stage = 'orphan'").select("id", "at"), "id")
    batch = e.filter("cluster_id IS NULL AND id % 20 = 0").select("id", "at").join(v, "id", "left")
    return C.assigned(batch, active, orphans, DIM)


@query("st01_online_assignment", f"WITH {_ONLINE} SELECT * FROM decided")
def st01(t):
    """What becomes of every unclustered event whose id is divisible by 20, as a batch: merge, create (a row for each member) or orphan."""
    return _decided(t)


@query("st04_merge_members", f"WITH {_ONLINE}, a AS (SELECT cluster_id, count(*) AS added FROM decided WHERE action = 'merge' GROUP BY 1) SELECT a.cluster_id, a.added, CAST(a.added + count(e.id) AS BIGINT) AS size FROM a LEFT JOIN events_now e ON e.cluster_id = a.cluster_id GROUP BY a.cluster_id, a.added")
def st04(t):
    """Clusters that the batch of st01 joins: members added, and the new size."""
    added = _decided(t).filter("action = 'merge'").select("cluster_id", F.col("member").alias("id"))
    m = C.merged(t.events("cluster_id").filter("cluster_id IS NOT NULL").select("cluster_id", "id"), cut(added))
    return m.groupBy("cluster_id").agg(F.count_if("new").alias("added"), F.count(F.lit(1)).alias("size")).filter("added > 0")


@query("st05_create_clusters", f"WITH {_ONLINE} SELECT id AS founder, count(*) AS size, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS members FROM decided WHERE action = 'create' GROUP BY 1")
def st05(t):
    """Clusters that the batch of st01 founds, always of four members."""
    made = _decided(t).filter("action = 'create'").groupBy(F.col("id").alias("founder"))
    return made.agg(F.count(F.lit(1)).alias("size"), F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("members"))


@query("x23_size_boosted", f"WITH {_ONLINE} SELECT query AS id, cluster_id, s AS score FROM votes")
def x23(t):
    """Every vote of st01: mean cosine of a cluster's members among the 20 nearest plus ln(n + 1) / 10."""
    e = t.events("lifecycle_stage", "cluster_id")
    active = _vectors(t).join(e.filter("lifecycle_stage = 'active' AND cluster_id IS NOT NULL").select("id", "cluster_id"), "id")
    asked = _vectors(t).join(e.filter("cluster_id IS NULL AND id % 20 = 0").select("id"), "id", "left_semi")
    near = V.search(asked, active.select("id", "v"), DIM, 20)
    g = near.join(active.select("id", "cluster_id"), "id").groupBy(F.col("query").alias("id"), "cluster_id")
    return g.agg(F.round(F.avg("cosine") + F.log(F.count(F.lit(1)) + 1) / 10, 9).alias("score"))


@query("x22_cosine", f"WITH {_CV}, {_MEAN}, l AS (SELECT cluster_id, list(mean ORDER BY d) AS m FROM m GROUP BY 1) SELECT c.id, round(list_cosine_similarity(c.v, l.m), 6) AS cosine, round(1 - list_cosine_similarity(c.v, l.m), 6) AS distance FROM c JOIN l USING (cluster_id)")
def x22(t):
    """Cosine and distance of every clustered event to its cluster's centroid."""
    rows = _clustered(t)
    m = V.centroid_vectors(rows, "cluster_id", "v").withColumnRenamed("v", "m")
    c = cosine(F.col("v"), F.col("m"))
    return rows.join(m, "cluster_id").select("id", F.round(c, 6).alias("cosine"), F.round(1 - c, 6).alias("distance"))


_KIND = f"list_filter([{', '.join('CASE WHEN ' + ' OR '.join(f"contains(lower(e.problem), '{k}')" for k in ks) + f" THEN '{c}' END" for c, ks in L.PAIN_TYPES.items())}], lambda x: x IS NOT NULL)"
_SUMMARY = f"""b AS (SELECT e.cluster_id, e.id, e.problem, e.context, e.emotional_signal, e.mentioned_tools, f.subreddit, f.pain_score, {_freq_sql('e.frequency')} AS score, {_KIND} AS kinds FROM events_now e LEFT JOIN filtered_now f ON f.id = e.post_id WHERE e.cluster_id IS NOT NULL),
k AS (SELECT cluster_id, unnest(kinds) AS k FROM b), kn AS (SELECT cluster_id, k, count(*) AS n FROM k GROUP BY 1, 2),
tool AS (SELECT cluster_id, unnest(from_json(mentioned_tools, '["VARCHAR"]')) AS k FROM b WHERE json_valid(mentioned_tools)),
counts AS (SELECT 'types' AS what, cluster_id, k, n FROM kn UNION ALL SELECT 'emotions', cluster_id, emotional_signal, count(*) FROM b WHERE trim(emotional_signal) <> '' GROUP BY 2, 3 UNION ALL SELECT 'tools', cluster_id, k, count(*) FROM tool WHERE trim(k) <> '' GROUP BY 2, 3 UNION ALL SELECT 'subs', cluster_id, subreddit, count(*) FROM b WHERE trim(subreddit) <> '' GROUP BY 2, 3),
txt AS (SELECT cluster_id, string_agg(k || ':' || n, ',' ORDER BY k) FILTER (WHERE what = 'types') AS types, string_agg(k || ':' || n, ',' ORDER BY k) FILTER (WHERE what = 'emotions') AS emotions, string_agg(k || ':' || n, ',' ORDER BY k) FILTER (WHERE what = 'tools') AS tools, string_agg(k || ':' || n, ',' ORDER BY k) FILTER (WHERE what = 'subs') AS subreddits FROM counts GROUP BY 1),
stat AS (SELECT cluster_id, count(*) AS size, round(avg(score) + 1e-9, 6) AS frequency, round(coalesce(sum(CASE WHEN isnan(pain_score) THEN 0 ELSE pain_score END), 0), 6) AS total_pain FROM b GROUP BY 1)"""


def _summary_rows(t):
    f = t.filtered("subreddit", "pain_score").select(F.col("id").alias("post_id"), "subreddit", "pain_score")
    e = t.events("cluster_id", "post_id", "problem", "context", "emotional_signal", "mentioned_tools", "frequency").filter("cluster_id IS NOT NULL")
    e = e.join(f, "post_id", "left").withColumn("score", X.first_score(F.col("frequency"), L.FREQUENCY, L.FREQUENCY_DEFAULT))
    return cut(e.select("cluster_id", "id", "problem", "context", "emotional_signal", "mentioned_tools", "subreddit", "pain_score", "score"))


def _summarised(b):
    """(cluster_id, size, frequency, total_pain, types, emotions, tools, subreddits)."""
    pain = F.when(~F.isnan("pain_score"), F.col("pain_score"))
    out = b.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("score") + 1e-9, 6).alias("frequency"), F.round(F.coalesce(F.sum(pain), F.lit(0.0)), 6).alias("total_pain"))
    kinds = b.select("cluster_id", F.explode(X.labels(F.lower("problem"), L.PAIN_TYPES)).alias("types"))
    tools = b.select("cluster_id", F.explode(F.from_json("mentioned_tools", "array<string>")).alias("tools"))
    for rows, key in ((kinds, "types"), (b, "emotional_signal"), (tools, "tools"), (b, "subreddit")):
        name = {"emotional_signal": "emotions", "subreddit": "subreddits"}.get(key, key)
        out = out.join(C.by_cluster(rows, key).withColumnRenamed("text", name), "cluster_id", "left")
    return out, kinds


@query("g23_cluster_summary", f"""WITH {_SUMMARY}, prim AS (SELECT cluster_id, arg_min(k, struct_pack(a := -n, b := k)) AS kind FROM kn GROUP BY 1),
five AS (SELECT cluster_id, string_agg(problem, ' | ' ORDER BY r) AS problems FROM (SELECT cluster_id, problem, row_number() OVER (PARTITION BY cluster_id ORDER BY length(problem) DESC, id) AS r FROM b WHERE problem <> '') WHERE r <= 5 GROUP BY 1),
trio AS (SELECT cluster_id, string_agg(context, ' | ' ORDER BY r) AS workarounds FROM (SELECT cluster_id, context, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM b WHERE contains(lower(context), 'workaround')) WHERE r <= 3 GROUP BY 1)
SELECT stat.*, subreddits, coalesce(kind, 'general') AS primary_type, types, emotions, tools, problems, workarounds FROM stat LEFT JOIN txt USING (cluster_id) LEFT JOIN prim USING (cluster_id) LEFT JOIN five USING (cluster_id) LEFT JOIN trio USING (cluster_id)""")
def g23(t):
    """The whole summary of every cluster: size, subreddits, kinds and the most frequent one (least name first), emotions, mean frequency, tools, the 5 longest problems, the first 3 contexts that tell of a workaround, and the pain of the posts."""
    b = _summary_rows(t)
    out, kinds = _summarised(b)
    n = kinds.groupBy("cluster_id", "types").agg(F.count(F.lit(1)).alias("n"))
    prim = n.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("o"), "types")).alias("m")).select("cluster_id", F.col("m.types").alias("kind"))
    five = top_per_key(b.filter("problem <> ''").select("cluster_id", "id", "problem", F.length("problem").alias("l")), "cluster_id", [F.desc("l"), F.asc("id")], 5, "id")
    five = five.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("l")).alias("o"), "id", "problem"))), lambda s: s["problem"]), " | ").alias("problems"))
    trio = top_per_key(b.filter(F.lower("context").contains("workaround")).select("cluster_id", "id", "context"), "cluster_id", [F.asc("id")], 3, "id")
    trio = trio.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "context"))), lambda s: s["context"]), " | ").alias("workarounds"))
    return out.join(prim, "cluster_id", "left").join(five, "cluster_id", "left").join(trio, "cluster_id", "left").select("cluster_id", "size", "frequency", "total_pain", "subreddits", F.coalesce("kind", F.lit("general")).alias("primary_type"), "types", "emotions", "tools", "problems", "workarounds")


@query("g24_cluster_characteristics", f"""WITH {_SUMMARY}, ten AS (SELECT cluster_id, string_agg(problem, ' | ' ORDER BY problem) AS problems FROM (SELECT cluster_id, problem, row_number() OVER (PARTITION BY cluster_id ORDER BY problem) AS r FROM (SELECT DISTINCT cluster_id, problem FROM b WHERE problem <> '')) WHERE r <= 10 GROUP BY 1)
SELECT stat.cluster_id, subreddits, tools, emotions, frequency, total_pain, problems FROM stat LEFT JOIN txt USING (cluster_id) LEFT JOIN ten USING (cluster_id)""")
def g24_characteristics(t):
    """Distributions of subreddits, tools and emotions of every cluster, and its first 10 different problems by code point."""
    b = _summary_rows(t)
    out, _ = _summarised(b)
    ten = top_per_key(b.filter("problem <> ''").select("cluster_id", "problem").distinct(), "cluster_id", [F.asc("problem")], 10, "problem")
    ten = ten.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("problem")), " | ").alias("problems"))
    return out.join(ten, "cluster_id", "left").select("cluster_id", "subreddits", "tools", "emotions", "frequency", "total_pain", "problems")


def _short_sql(column, n):
    return f"CASE WHEN length({column}) <= {n} THEN {column} ELSE substr({column}, 1, {n - 3}) || '...' END"


_COMPACT = f"""{_SUMMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN isnan(pain_score) THEN NULL ELSE pain_score END DESC NULLS LAST, id) AS place FROM b),
compact AS (SELECT cluster_id, place, {_short_sql('problem', 200)} AS problem, {_short_sql('context', 200)} AS context, emotional_signal, score FROM r WHERE place <= 20)"""


def _compact(b):
    pain = F.when(~F.isnan("pain_score"), F.col("pain_score"))
    from pyspark.sql import Window

    top = top_per_key(b.withColumn("pain", pain), "cluster_id", [F.desc_nulls_last("pain"), F.asc("id")], 20, "id")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("pain"), "id"))
    return top.select("cluster_id", place.cast("long").alias("place"), X.ellipsis(F.col("problem"), 200).alias("problem"), X.ellipsis(F.col("context"), 200).alias("context"), "emotional_signal", "score")


@query("x35_compact_summary", f"WITH {_COMPACT} SELECT c.*, k.cluster_name AS name, {_short_sql('k.centroid_summary', 500)} AS description, stat.size FROM compact c JOIN stat USING (cluster_id) LEFT JOIN clusters k ON k.id = c.cluster_id")
def x35(t):
    """The 20 events of every cluster whose posts have most pain, texts cut to 200 characters, with the cluster's name, description to 500 and size."""
    b = _summary_rows(t)
    k = t.clusters.select(F.col("id").alias("cluster_id"), F.col("cluster_name").alias("name"), X.ellipsis(F.col("centroid_summary"), 500).alias("description"))
    sizes = b.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return _compact(b).join(sizes, "cluster_id").join(k, "cluster_id", "left")


@query("x36_compression_ratio", f"WITH {_COMPACT}, o AS (SELECT cluster_id, sum(length(coalesce(problem, '')) + length(coalesce(context, ''))) AS n FROM b GROUP BY 1), c AS (SELECT cluster_id, sum(length(coalesce(problem, '')) + length(coalesce(context, ''))) AS n FROM compact GROUP BY 1) SELECT o.cluster_id, round((1 - c.n / greatest(o.n, 1)) * 100 + 1e-9, 6) AS saved FROM o JOIN c USING (cluster_id)")
def x36(t):
    """By how many per cent the compact summary is shorter than the texts of all events."""
    b = _summary_rows(t)
    n = lambda df, name: df.groupBy("cluster_id").agg(F.sum(F.length(F.coalesce("problem", F.lit(""))) + F.length(F.coalesce("context", F.lit("")))).alias(name))
    both = n(b, "o").join(n(_compact(b), "c"), "cluster_id")
    return both.select("cluster_id", F.round((1 - F.col("c") / F.greatest("o", F.lit(1))) * 100 + 1e-9, 6).alias("saved"))


_METRICS = f"m AS (SELECT c.id, c.cluster_name, count(e.id) AS size, count(DISTINCT f.author) AS authors, count(DISTINCT f.subreddit) AS subs, avg(CASE WHEN e.id IS NOT NULL THEN {_freq_sql('e.frequency')} END) AS freq, max(e.extracted_at) AS latest FROM clusters c LEFT JOIN events_now e ON e.cluster_id = c.id LEFT JOIN filtered_now f ON f.id = e.post_id GROUP BY 1, 2)"


@query("st11_change_detection", f"""WITH {_SNAPSHOTS}, l AS (SELECT cluster_id, size AS s0, authors AS a0, subs AS b0, hour FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY hour DESC, id DESC) AS r FROM s) WHERE r = 1), {_METRICS},
d AS (SELECT m.id AS cluster_id, l.s0, m.size - s0 AS ds, m.authors - a0 AS da, m.subs - b0 AS db, CAST(floor((744 - hour) / 24) AS BIGINT) AS days FROM m LEFT JOIN l ON l.cluster_id = m.id),
w AS (SELECT cluster_id, s0, ds, concat_ws('; ', CASE WHEN ds >= 5 THEN 'Added ' || ds || ' new events' END, CASE WHEN s0 > 0 AND ds / s0 >= 0.1 THEN 'Added ' || printf('%.1f', 100.0 * ds / s0) || '% new events' END, CASE WHEN da >= 3 THEN 'Added ' || da || ' new authors' END, CASE WHEN db >= 2 THEN 'Cross-subreddit count increased by ' || db END, CASE WHEN days >= 7 THEN days || ' days since last snapshot' END) AS reasons FROM d)
SELECT cluster_id, CASE WHEN s0 IS NULL THEN 'new_cluster' ELSE 'significant_update' END AS change_type, CASE WHEN s0 IS NULL THEN 'First time scoring' ELSE reasons END AS reasons, CASE WHEN s0 IS NULL OR ds >= 20 THEN 'high' ELSE 'medium' END AS priority FROM w WHERE s0 IS NULL OR reasons <> ''""")
def st11(t):
    """Clusters that changed since their last snapshot, with all reasons and the priority; those without a snapshot are new. Snapshots count hours up to 744, which is now."""
    last = snapshots(t).groupBy(F.col("cluster_id").alias("id")).agg(F.max_by(F.struct("size", "authors", "subs", "hour"), F.struct("hour", "id")).alias("l"))
    d = cluster_metrics(t).join(last, "id", "left")
    ds, da, db = F.col("size") - F.col("l.size"), F.col("authors") - F.col("l.authors"), F.col("subreddits") - F.col("l.subs")
    days, ratio = F.floor((744 - F.col("l.hour")) / 24), F.col("l.size")
    why = F.concat_ws(
        "; ",
        F.when(ds >= 5, F.format_string("Added %d new events", ds)),
        F.when((ratio > 0) & (ds / ratio >= 0.1), F.concat(F.lit("Added "), F.format_string("%.1f", F.round(F.lit(100.0) * ds / ratio, 9)), F.lit("% new events"))),
        F.when(da >= 3, F.format_string("Added %d new authors", da)),
        F.when(db >= 2, F.format_string("Cross-subreddit count increased by %d", db)),
        F.when(days >= 7, F.format_string("%d days since last snapshot", days)),
    )
    new = F.col("l").isNull()
    d = d.select(F.col("id").alias("cluster_id"), F.when(new, "new_cluster").otherwise("significant_update").alias("change_type"), F.when(new, "First time scoring").otherwise(why).alias("reasons"), F.when(new | (ds >= 20), "high").otherwise("medium").alias("priority"))
    return d.filter("reasons <> ''")


@query("snk10_snapshot_append", f"WITH {_SNAPSHOTS}, {_METRICS} SELECT cluster_id, CAST(hour AS BIGINT) AS hour, CAST(size AS BIGINT) AS size, CAST(authors AS BIGINT) AS authors, CAST(subs AS BIGINT) AS subs, NULL AS frequency, NULL AS latest, 'history' AS reason FROM s UNION ALL SELECT id, 744, size, authors, subs, round(coalesce(freq, 0) + 1e-9, 6), CAST(latest AS VARCHAR), 'after_cluster_update' FROM m")
def snk10(t):
    """The snapshot history with a row of every cluster's metrics appended."""
    old = snapshots(t).select("cluster_id", *[F.col(c).cast("long").alias(c) for c in ("hour", "size", "authors", "subs")], F.lit(None).cast("double").alias("frequency"), F.lit(None).cast("string").alias("latest"), F.lit("history").alias("reason"))
    new = cluster_metrics(t).select(F.col("id").alias("cluster_id"), F.lit(744).cast("long").alias("hour"), "size", "authors", F.col("subreddits").alias("subs"), F.round(F.coalesce("frequency", F.lit(0.0)) + 1e-9, 6).alias("frequency"), F.col("latest").cast("string").alias("latest"), F.lit("after_cluster_update").alias("reason"))
    return old.unionByName(new)


@query("st15_alignment_status", "WITH g AS (SELECT id, source_type, cluster_size, lower(trim(cluster_name)) AS n, (alignment_status = 'unprocessed' OR alignment_status IS NULL) AND cluster_size >= 3 AS eligible, alignment_status FROM clusters), a AS (SELECT n, min(id) AS aligned FROM g WHERE eligible AND n <> '' GROUP BY 1 HAVING count(DISTINCT source_type) >= 2) SELECT g.id, CASE WHEN NOT coalesce(eligible, false) THEN alignment_status WHEN aligned IS NOT NULL THEN 'aligned' ELSE 'processed' END AS status, CASE WHEN eligible THEN aligned END AS aligned_id FROM g LEFT JOIN a USING (n)", now=False)
def st15(t):
    """The next status of every cluster: unprocessed ones of at least 3 events become aligned with those of their name if these are of two sources, else processed; others keep theirs."""
    s = F.col("alignment_status")
    eligible = F.coalesce(((s == "unprocessed") | s.isNull()) & (F.col("cluster_size") >= 3), F.lit(False))
    g = t.clusters.select("id", "source_type", F.lower(F.trim("cluster_name")).alias("n"), eligible.alias("eligible"), "alignment_status")
    a = g.filter("eligible AND n <> ''").groupBy("n").agg(F.countDistinct("source_type").alias("k"), F.min("id").alias("aligned")).filter("k >= 2").select("n", "aligned")
    out = g.join(a, "n", "left")
    status = F.when(~F.col("eligible"), F.col("alignment_status")).when(F.col("aligned").isNotNull(), "aligned").otherwise("processed")
    return out.select("id", status.alias("status"), F.when(F.col("eligible"), F.col("aligned")).alias("aligned_id"))


@query("st07_touched_clusters", f"SELECT e.cluster_id, count(*) AS n, CAST(max(e.extracted_at) AS VARCHAR) AS latest FROM events_now e WHERE e.cluster_id IN (SELECT id FROM clusters WHERE created_at > (SELECT max(created_at) FROM clusters) - INTERVAL 1 HOUR) GROUP BY 1")
def st07(t):
    """Clusters written within the hour before the newest one, recomputed."""
    now = F.lit(t.clusters.agg(F.max("created_at")).head()[0]).cast("timestamp_ntz")
    touched = t.clusters.filter(F.col("created_at") > now - F.expr("INTERVAL 1 HOUR")).select(F.col("id").alias("cluster_id"))
    e = t.events("cluster_id", "extracted_at").join(touched, "cluster_id", "left_semi")
    return e.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("extracted_at").cast("string").alias("latest"))


@query("g27_lifecycle_stats", f"SELECT count(*) AS n, count(*) FILTER (WHERE cluster_id IS NOT NULL) AS active, count(*) FILTER (WHERE cluster_id IS NULL) AS orphans, count(*) FILTER (WHERE cluster_id IS NULL AND orphan_since < {_AS_OF} - INTERVAL 14 DAY) AS expired, round(100.0 * count(*) FILTER (WHERE cluster_id IS NOT NULL) / greatest(count(*), 1), 4) AS retention_rate FROM events_now")
def g27(t):
    """Active, orphaned and expired events (orphans for more than 14 days) and the share retained."""
    k = F.count_if(F.col("cluster_id").isNotNull())
    gone = F.count_if(F.expr(f"cluster_id IS NULL AND orphan_since < {AS_OF} - INTERVAL 14 DAY"))
    n = F.count(F.lit(1))
    return t.events("cluster_id", "orphan_since").agg(n.alias("n"), k.alias("active"), (n - k).alias("orphans"), gone.alias("expired"), F.round(F.lit(100.0) * k / F.greatest(n, F.lit(1)), 4).alias("retention_rate"))
