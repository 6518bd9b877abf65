"""Further operators: samples, appends, versions, model calls, geometry."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.catalog.base import query
from siftspark.catalog.vectors import DIM, _V, _vectors
from siftspark.functions import lexicons as L
from siftspark.functions import model as M
from siftspark.functions import text as X
from siftspark.operators import vector as V
from siftspark.operators.sinks import with_next_ids


def _n():
    return F.count(F.lit(1))


@query("g29_pattern_coverage", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS numbers, count(*) FILTER (WHERE contains(text, '?')) AS questions, count(*) FILTER (WHERE regexp_matches(lower(text), 'workaround|tool')) AS tools, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL", now=False)
def g29(t):
    d = t.raw("documents", "text").filter("text IS NOT NULL")
    text = F.col("text")
    return d.agg(_n().alias("n"), F.count_if(text.rlike("[0-9]")).alias("numbers"), F.count_if(text.contains("?")).alias("questions"), F.count_if(F.lower(text).rlike("workaround|tool")).alias("tools"), F.sum(F.length(text)).cast("long").alias("chars"))


@query("g31_level_counts", "SELECT CASE WHEN size >= 10 AND subs >= 3 THEN 1 WHEN size >= 8 AND subs >= 2 THEN 2 ELSE 0 END AS level, count(*) AS n FROM (SELECT e.cluster_id, count(DISTINCT e.id) AS size, count(DISTINCT p.subreddit) AS subs FROM events_now e LEFT JOIN posts_now p ON p.id = e.post_id WHERE e.cluster_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def g31(t):
    p = t.posts("subreddit").select(F.col("id").alias("post_id"), "subreddit")
    e = t.events("cluster_id", "post_id").filter("cluster_id IS NOT NULL").join(p, "post_id", "left")
    m = e.groupBy("cluster_id").agg(_n().alias("size"), F.countDistinct("subreddit").alias("subs"))
    level = F.when((F.col("size") >= 10) & (F.col("subs") >= 3), 1).when((F.col("size") >= 8) & (F.col("subs") >= 2), 2).otherwise(0)
    return m.groupBy(level.alias("level")).agg(_n().alias("n"))


@query("g40_durations", "SELECT id, date_diff('microsecond', created_at, collected_at) / 1e6 AS seconds FROM posts_now WHERE created_at IS NOT NULL AND collected_at IS NOT NULL")
def g40(t):
    p = t.posts("created_at").filter("created_at IS NOT NULL AND collected_at IS NOT NULL")
    return p.select("id", (F.expr("timestampdiff(MICROSECOND, created_at, collected_at)") / 1e6).alias("seconds"))


@query("w06_ordered_limit", "SELECT id, score FROM posts_now WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 20")
def w06(t):
    return t.posts("score").filter("score IS NOT NULL").select("id", "score").orderBy(F.desc("score"), "id").limit(20)


@query("w09_top_events_per_post", "SELECT post_id, id FROM (SELECT post_id, id, row_number() OVER (PARTITION BY post_id ORDER BY extraction_confidence DESC NULLS LAST, id) AS r FROM events_now WHERE post_id IS NOT NULL) WHERE r <= 3")
def w09(t):
    r = F.row_number().over(Window.partitionBy("post_id").orderBy(F.desc_nulls_last("extraction_confidence"), "id"))
    return t.events("post_id", "extraction_confidence").filter("post_id IS NOT NULL").withColumn("r", r).filter("r <= 3").select("post_id", "id")


@query("w10_hash_sample", "SELECT id FROM posts_now ORDER BY md5(id), id LIMIT 10")
def w10(t):
    """A repeatable random sample: the least hashes."""
    return t.posts().select("id").orderBy(F.md5("id"), "id").limit(10)


@query("snk03_append_with_ids", "SELECT id AS event_id, (SELECT max(id) FROM pain_events) + row_number() OVER (ORDER BY id) AS new_id FROM events_now WHERE cluster_id IS NULL")
def snk03(t):
    last = t.raw("pain_events", "id").agg(F.max("id")).head()[0] or 0
    rows = t.events("cluster_id").filter("cluster_id IS NULL").select(F.col("id").alias("event_id"))
    return with_next_ids(rows, ["event_id"], "new_id", last)


@query("j19_name_containment", "SELECT o.id, c.id AS cluster FROM opportunities o JOIN clusters c ON c.id = o.cluster_id WHERE trim(coalesce(c.cluster_name, '')) <> '' AND contains(lower(o.description), lower(trim(regexp_extract(c.cluster_name, '[^ ]+$'))))", now=False)
def j19(t):
    c = t.clusters.filter("trim(coalesce(cluster_name, '')) <> ''").select(F.col("id").alias("cluster"), F.lower(F.trim(F.regexp_extract("cluster_name", "[^ ]+$", 0))).alias("last"))
    both = t.opportunities.join(c, F.col("cluster_id") == F.col("cluster"))
    return both.filter(F.contains(F.lower("description"), F.col("last"))).select("id", "cluster")


@query("x32_title_classifier", "SELECT id, CASE WHEN contains(lower(title), '?') THEN 'question' WHEN contains(lower(title), 'would pay') THEN 'offer' WHEN contains(lower(title), 'problem') THEN 'problem' ELSE 'story' END AS kind FROM posts_now WHERE title IS NOT NULL")
def x32(t):
    low = F.lower("title")
    kind = F.when(low.contains("?"), "question").when(low.contains("would pay"), "offer").when(low.contains("problem"), "problem").otherwise("story")
    return t.posts("title").filter("title IS NOT NULL").select("id", kind.alias("kind"))


_ETEXT = "concat_ws(' | ', nullif(problem, ''), nullif(context, ''))"


@query("v01_embedding_text", f"SELECT id, CASE WHEN length(x) > 2000 THEN substr(x, 1, 1000) ELSE x END AS text FROM (SELECT id, {_ETEXT} AS x FROM events_now)")
def v01(t):
    x = X.joined(" | ", "problem", "context")
    return t.events("problem", "context").select("id", F.when(F.length(x) > 2000, F.left(x, F.lit(1000))).otherwise(x).alias("text"))


@query("v02_embedding_cache", f"SELECT id FROM events_now WHERE regexp_matches({_ETEXT}, '[A-Za-z0-9]')")
def v02(t):
    """Ids of the events that get a vector; every distinct text is embedded once, by the offline stand-in."""
    rows = t.events("problem", "context").select("id", X.joined(" | ", "problem", "context").alias("text"))
    return M.embedded(rows).select("id")


@query("v04_pairwise_similarity", f"WITH {_V}, c AS (SELECT e.cluster_id, v.id, v.v FROM v JOIN events_now e ON e.id = v.id WHERE e.id % 20 = 0 AND e.cluster_id IS NOT NULL) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b ON a.cluster_id = b.cluster_id AND a.id < b.id")
def v04(t):
    """Cosines of all pairs of the query set (ids divisible by 20) inside each cluster."""
    e = t.events("cluster_id").filter("cluster_id IS NOT NULL AND id % 20 = 0").select("id", "cluster_id")
    rows = _vectors(t).filter(V.usable(F.col("v"), DIM)).join(e, "id")
    other = rows.select("cluster_id", F.col("id").alias("b"), F.col("v").alias("u"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, u = F.col("v"), F.col("u")
    pairs = rows.join(other, "cluster_id").filter("id < b")
    return pairs.select(F.col("id").alias("a"), "b", F.round(dot(v, u) / F.sqrt(dot(v, v) * dot(u, u)), 6).alias("cosine"))


@query("v04_query_similarity", f"WITH {_V}, c AS (SELECT e.cluster_id, v.id, v.v FROM v JOIN events_now e ON e.id = v.id WHERE e.cluster_id IS NOT NULL) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b ON a.cluster_id = b.cluster_id AND a.id <> b.id WHERE a.id % 20 = 0")
def v04_query(t):
    """Cosines of every event of the query set (ids divisible by 20) with all other members of its cluster, by matrix products; large clusters are cut into parts."""
    e = t.events("cluster_id").filter("cluster_id IS NOT NULL").select("id", "cluster_id")
    rows = _vectors(t).filter(V.usable(F.col("v"), DIM)).join(e, "id")
    return V.pairs_in_groups(rows.withColumn("asks", F.col("id") % 20 == 0), "cluster_id", DIM)


@query("u01_extract_events", None)
def u01(t):
    """(post_id, place, problem, confidence, mentioned_tools) by the offline stand-in of the model."""
    rows = t.posts("title", "body").select("id", F.concat_ws(". ", "title", "body").alias("text"))
    return M.extract_events(rows, M.RuleModel())


@query("u02_enriched_events", None)
def u02(t):
    """Extracted events that pass the validator, with their post's subreddit and the kinds of pain."""
    p = t.posts("subreddit").select(F.col("id").alias("post_id"), "subreddit")
    e = u01(t).filter(F.length("problem").between(10, 1000) & (F.col("confidence") >= 0.3) & ~F.lower("problem").isin(L.GENERIC_PROBLEMS))
    return e.join(p, "post_id").withColumn("kinds", X.labels(F.lower("problem"), L.PAIN_TYPES))


@query("m13_rollback", "SELECT id, cluster_name FROM clusters", now=False)
def m13(t):
    return t.raw("clusters").withColumn("added", F.lit(1)).drop("added").select("id", "cluster_name")


@query("st13_versioned_rescoring", "SELECT o.id, o.cluster_id FROM opportunities o WHERE o.cluster_id NOT IN (SELECT id FROM clusters WHERE alignment_status = 'unprocessed') OR o.cluster_id IS NULL UNION ALL SELECT -c.id, c.id FROM clusters c WHERE c.alignment_status = 'unprocessed'", now=False)
def st13(t):
    again = t.clusters.filter("alignment_status = 'unprocessed'").select(F.col("id").alias("cluster_id"))
    kept = t.opportunities.select("id", "cluster_id").join(again, "cluster_id", "left_anti").select("id", "cluster_id")
    return kept.unionByName(again.select((-F.col("cluster_id")).alias("id"), "cluster_id"))
