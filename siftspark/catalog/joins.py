"""Joins and source scans."""

from pyspark.sql import functions as F

from siftspark.catalog.base import query
from siftspark.functions import lexicons as L
from siftspark.functions import text as X
from siftspark.operators.merge import merge_upsert


@query("src03_multi_source_union", "SELECT source, count(*) AS n FROM (SELECT coalesce(source, 'none') AS source FROM posts_now UNION ALL SELECT coalesce(source_type, 'none') FROM clusters) GROUP BY 1")
def src03(t):
    both = t.posts("source").select("source").unionByName(t.clusters.select(F.col("source_type").alias("source")), allowMissingColumns=True)
    return both.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("src04_record_normaliser", "SELECT 'reddit_' || source_id AS uid, CASE WHEN trim(coalesce(author, '')) = '' THEN '[deleted]' ELSE author END AS author, CAST(CAST(floor(created_utc) AS BIGINT) AS BIGINT) AS created, coalesce(score, 0) AS score FROM posts_now WHERE source_id IS NOT NULL")
def src04(t):
    df = t.posts("source_id", "author", "created_utc", "score").filter("source_id IS NOT NULL")
    author = F.when(F.trim(F.coalesce("author", F.lit(""))) == "", "[deleted]").otherwise(F.col("author"))
    return df.select(F.concat(F.lit("reddit_"), "source_id").alias("uid"), author.alias("author"), F.floor("created_utc").cast("long").alias("created"), F.coalesce("score", F.lit(0)).alias("score"))


@query("src05_incremental_scan", "SELECT DISTINCT id FROM posts p WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM filtered_posts f WHERE f.id = p.id)", now=False)
def src05(t):
    return t.raw("posts", "id").filter("id IS NOT NULL").join(t.raw("filtered_posts", "id"), "id", "left_anti").distinct()


@query("src06_query_builder", " UNION ALL ".join(f"SELECT '{c}' AS category, '" + " OR ".join('"' + k.replace("'", "''") + '"' for k in ks[:5]) + "' AS query" for c, ks in L.PAIN.items()), now=False)
def src06(t):
    df = t.spark.createDataFrame(list(L.PAIN.items()), "category string, words array<string>")
    return df.select("category", F.array_join(F.transform(F.slice("words", 1, 5), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ").alias("query"))


@query("src10_projected_scan", "SELECT id, cluster_name, cluster_size FROM clusters", now=False)
def src10(t):
    return t.raw("clusters", "id", "cluster_name", "cluster_size")


@query("src11_vector_point_get", "SELECT e.pain_event_id, len(e.embedding_vector) AS n FROM emb_now e WHERE e.pain_event_id IN (SELECT id FROM pain_events WHERE post_id = 'p_000000001')")
def src11(t):
    ids = t.raw("pain_events", "id", "post_id").filter("post_id = 'p_000000001'").select(F.col("id").alias("pain_event_id"))
    got = t.embeddings("embedding_vector").join(ids, "pain_event_id", "left_semi")
    return got.select("pain_event_id", F.when(F.col("embedding_vector").isNotNull(), F.size("embedding_vector").cast("long")).alias("n"))


@query("src14_sample_events", "SELECT cluster_id, id, problem FROM (SELECT cluster_id, id, problem, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM events_now WHERE cluster_id IS NOT NULL) WHERE r <= 5")
def src14(t):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))
    return t.events("cluster_id", "problem").filter("cluster_id IS NOT NULL").withColumn("r", r).filter("r <= 5").select("cluster_id", "id", "problem")


@query("snk01_merge_upsert", "SELECT id, subreddit, score FROM posts_now")
def snk01(t):
    old = t.raw("posts").filter("collected_at < TIMESTAMP_NTZ '2024-03-01 00:00:00'")
    new = t.raw("posts").filter("collected_at >= TIMESTAMP_NTZ '2024-03-01 00:00:00' OR collected_at IS NULL")
    return merge_upsert(old, new, "id", "collected_at", ["subreddit", "score"]).select("id", "subreddit", "score")


@query("snk02_filtered_upsert", "SELECT id, pain_score, pass_type FROM filtered_now WHERE trim(id) <> ''")
def snk02(t):
    rows = t.raw("filtered_posts").filter("trim(id) <> ''")
    return merge_upsert(rows.limit(0), rows, "id", "filtered_at", ["pain_score", "pass_type"]).select("id", "pain_score", "pass_type")


@query("snk04_embedding_upsert", "SELECT pain_event_id, embedding_model FROM emb_now")
def snk04(t):
    rows = t.raw("pain_embeddings")
    return merge_upsert(rows.limit(0), rows, "pain_event_id", "created_at", ["embedding_model"]).select("pain_event_id", "embedding_model")


@query("snk05_vector_delete", "SELECT e.pain_event_id FROM emb_now e WHERE EXISTS (SELECT 1 FROM pain_events p WHERE p.id = e.pain_event_id)")
def snk05(t):
    gone = t.embeddings().select("pain_event_id").join(t.raw("pain_events", "id").withColumnRenamed("id", "pain_event_id"), "pain_event_id", "left_anti")
    return t.embeddings().select("pain_event_id").join(gone, "pain_event_id", "left_anti")


@query("snk07_delete_by_cluster", "SELECT o.id FROM opportunities o WHERE NOT EXISTS (SELECT 1 FROM clusters c WHERE c.id = o.cluster_id AND c.alignment_status = 'archived')", now=False)
def snk07(t):
    gone = t.clusters.filter("alignment_status = 'archived'").select(F.col("id").alias("cluster_id"))
    return t.opportunities.join(gone, "cluster_id", "left_anti").select("id")


@query("snk08_bulk_fk_update", "SELECT e.id, coalesce(n.new_id, e.cluster_id) AS cluster_id FROM events_now e LEFT JOIN (SELECT post_id, min(cluster_id) AS new_id FROM events_now WHERE cluster_id IS NOT NULL AND post_id IS NOT NULL GROUP BY 1) n ON n.post_id = e.post_id")
def snk08(t):
    events = t.events("cluster_id", "post_id")
    new = events.filter("cluster_id IS NOT NULL AND post_id IS NOT NULL").groupBy("post_id").agg(F.min("cluster_id").alias("new_id"))
    return events.join(new, "post_id", "left").select("id", F.coalesce("new_id", "cluster_id").alias("cluster_id"))


@query("snk12_json_report", "SELECT id, '{\"name\":' || coalesce(to_json(opportunity_name), 'null') || ',\"cluster\":' || coalesce(CAST(cluster_id AS VARCHAR), 'null') || '}' AS doc FROM opportunities WHERE opportunity_name IS NOT NULL AND cluster_id IS NOT NULL", now=False)
def snk12(t):
    rows = t.opportunities.filter("opportunity_name IS NOT NULL AND cluster_id IS NOT NULL")
    return rows.select("id", F.to_json(F.struct(F.col("opportunity_name").alias("name"), F.col("cluster_id").alias("cluster"))).alias("doc"))


def _oc(t, how="inner"):
    c = t.clusters.select(F.col("id").alias("cluster_id"), "cluster_name", "cluster_size")
    return t.opportunities.join(c, "cluster_id", how)


@query("j01_opportunities_clusters", "SELECT o.id, o.opportunity_name, c.cluster_name, c.cluster_size FROM opportunities o JOIN clusters c ON c.id = o.cluster_id", now=False)
def j01(t):
    return _oc(t).select("id", "opportunity_name", "cluster_name", "cluster_size")


@query("j02_opportunities_left_clusters", "SELECT o.id, c.cluster_name FROM opportunities o LEFT JOIN clusters c ON c.id = o.cluster_id", now=False)
def j02(t):
    return _oc(t, "left").select("id", "cluster_name")


@query("j03_events_filtered_by_cluster", "SELECT e.cluster_id, e.id, f.author FROM events_now e JOIN filtered_now f ON f.id = e.post_id JOIN clusters c ON c.id = e.cluster_id")
def j03(t):
    ids = t.clusters.select(F.col("id").alias("cluster_id"))
    posts = t.filtered("author").select(F.col("id").alias("post_id"), "author")
    return t.events("cluster_id", "post_id").join(ids, "cluster_id", "left_semi").join(posts, "post_id").select("cluster_id", "id", "author")


@query("j04_events_without_embedding", "SELECT id FROM events_now e WHERE NOT EXISTS (SELECT 1 FROM emb_now m WHERE m.pain_event_id = e.id)")
def j04(t):
    return t.events().select("id").join(t.embeddings().select(F.col("pain_event_id").alias("id")), "id", "left_anti")


@query("j05_events_embeddings", "SELECT e.id, m.embedding_model FROM events_now e JOIN emb_now m ON m.pain_event_id = e.id")
def j05(t):
    m = t.embeddings("embedding_model").select(F.col("pain_event_id").alias("id"), "embedding_model")
    return t.events().select("id").join(m, "id").select("id", "embedding_model")


@query("j06_unclustered_with_source", "SELECT e.id, coalesce(p.source, 'reddit') AS source FROM events_now e JOIN emb_now m ON m.pain_event_id = e.id LEFT JOIN posts_now p ON p.id = e.post_id WHERE e.cluster_id IS NULL")
def j06(t):
    e = t.events("cluster_id", "post_id").filter("cluster_id IS NULL").select("id", "post_id")
    m = t.embeddings().select(F.col("pain_event_id").alias("id"))
    p = t.posts("source").select(F.col("id").alias("post_id"), "source")
    return e.join(m, "id", "left_semi").join(p, "post_id", "left").select("id", F.coalesce("source", F.lit("reddit")).alias("source"))


@query("j07_posts_not_filtered", "SELECT id FROM posts_now p WHERE NOT EXISTS (SELECT 1 FROM filtered_posts f WHERE f.id = p.id)")
def j07(t):
    return t.posts().select("id").join(t.raw("filtered_posts", "id"), "id", "left_anti")


@query("j08_clusters_without_opportunity", "SELECT id FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM opportunities o WHERE o.cluster_id = c.id)", now=False)
def j08(t):
    return t.clusters.select("id").join(t.opportunities.select(F.col("cluster_id").alias("id")), "id", "left_anti")


@query("j09_filtered_not_extracted", "SELECT id FROM filtered_now f WHERE NOT EXISTS (SELECT 1 FROM pain_events e WHERE e.post_id = f.id)")
def j09(t):
    return t.filtered().select("id").join(t.raw("pain_events", "post_id").select(F.col("post_id").alias("id")), "id", "left_anti")


@query("j10_anti_store", "SELECT id FROM events_now e WHERE lifecycle_stage = 'active' AND NOT EXISTS (SELECT 1 FROM emb_now m WHERE m.pain_event_id = e.id AND m.embedding_vector IS NOT NULL)")
def j10(t):
    stored = t.embeddings("embedding_vector").filter("embedding_vector IS NOT NULL").select(F.col("pain_event_id").alias("id"))
    return t.events("lifecycle_stage").filter("lifecycle_stage = 'active'").select("id").join(stored, "id", "left_anti")


@query("j11_lookup_set_based", "SELECT o.id, e.id AS event_id, p.title FROM opportunities o JOIN events_now e ON e.cluster_id = o.cluster_id LEFT JOIN posts_now p ON p.id = e.post_id")
def j11(t):
    e = t.events("cluster_id", "post_id").select(F.col("id").alias("event_id"), "cluster_id", "post_id")
    p = t.posts("title").select(F.col("id").alias("post_id"), "title")
    return t.opportunities.select("id", "cluster_id").join(e, "cluster_id").join(p, "post_id", "left").select("id", "event_id", "title")


@query("j12_clusters_opportunity_stats", "SELECT c.id, count(o.id) AS opportunities, max(o.total_score) AS best FROM clusters c LEFT JOIN opportunities o ON o.cluster_id = c.id GROUP BY c.id HAVING count(o.id) > 0", now=False)
def j12(t):
    o = t.opportunities.filter("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("opportunities"), F.max("total_score").alias("best"))
    return t.clusters.select("id").join(o, "id")


@query("j13_semi_in", "SELECT id FROM opportunities WHERE cluster_id IN (SELECT id FROM clusters WHERE cluster_size >= 20)", now=False)
def j13(t):
    return t.opportunities.join(t.clusters.filter("cluster_size >= 20").select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select("id")


@query("j14_delete_not_in", "SELECT id FROM opportunities WHERE id IN (SELECT max(id) FROM opportunities GROUP BY cluster_id)", now=False)
def j14(t):
    keep = t.opportunities.groupBy("cluster_id").agg(F.max("id").alias("id")).select("id")
    return t.opportunities.select("id").join(keep, "id", "left_semi")


@query("j20_parent_post_context", "SELECT e.id, p.title, substr(p.body, 1, 500) AS body FROM events_now e LEFT JOIN posts_now p ON p.id = e.post_id")
def j20(t):
    p = t.posts("title", "body").select(F.col("id").alias("post_id"), "title", F.substring("body", 1, 500).alias("body"))
    return t.events("post_id").select("id", "post_id").join(p, "post_id", "left").select("id", "title", "body")


@query("j21_clusters_by_ids", "SELECT id, cluster_name FROM clusters WHERE id IN (SELECT cluster_id FROM opportunities WHERE total_score >= 8)", now=False)
def j21(t):
    ids = t.opportunities.filter("total_score >= 8").select(F.col("cluster_id").alias("id"))
    return t.clusters.select("id", "cluster_name").join(ids, "id", "left_semi")


@query("j22_delete_preview", "SELECT o.id, c.cluster_name, o.total_score FROM opportunities o JOIN clusters c ON c.id = o.cluster_id WHERE o.id NOT IN (SELECT max(id) FROM opportunities GROUP BY cluster_id)", now=False)
def j22(t):
    keep = t.opportunities.groupBy("cluster_id").agg(F.max("id").alias("id")).select("id")
    return _oc(t).join(keep, "id", "left_anti").select("id", "cluster_name", "total_score")


@query("x03_ellipsis", "SELECT id, coalesce(opportunity_name, '') || ': ' || CASE WHEN length(description) <= 60 THEN description ELSE substr(description, 1, 57) || '...' END AS label FROM opportunities WHERE description IS NOT NULL", now=False)
def x03(t):
    rows = t.opportunities.filter("description IS NOT NULL")
    return rows.select("id", F.concat(F.coalesce("opportunity_name", F.lit("")), F.lit(": "), X.ellipsis(F.col("description"), 60)).alias("label"))
