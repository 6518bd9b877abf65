"""Incremental maintenance: states, expiry, change detection, schema evolution, duplicates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.catalog.base import query
from siftspark.operators.schema import evolve

AS_OF = "TIMESTAMP_NTZ '2024-05-01 00:00:00'"
_AS_OF = "TIMESTAMP '2024-05-01 00:00:00'"


@query("st06_mark_orphans", f"SELECT id, CASE WHEN cluster_id IS NULL THEN CAST(coalesce(orphan_since, {_AS_OF}) AS VARCHAR) END AS orphan_since FROM events_now")
def st06(t):
    e = t.events("cluster_id", "orphan_since")
    return e.select("id", F.when(F.col("cluster_id").isNull(), F.coalesce("orphan_since", F.expr(AS_OF)).cast("string")).alias("orphan_since"))


@query("st08_orphan_expiry", f"SELECT id FROM events_now WHERE NOT (cluster_id IS NULL AND coalesce(orphan_since, {_AS_OF}) < {_AS_OF} - INTERVAL 14 DAY)")
def st08(t):
    gone = f"cluster_id IS NULL AND coalesce(orphan_since, {AS_OF}) < {AS_OF} - INTERVAL 14 DAY"
    return t.events("cluster_id", "orphan_since").filter(f"NOT ({gone})").select("id")


@query("st09_archive_inactive", f"SELECT id, CASE WHEN created_at < {_AS_OF} - INTERVAL 90 DAY AND alignment_status <> 'archived' THEN 'archived' ELSE alignment_status END AS status FROM clusters", now=False)
def st09(t):
    old = F.expr(f"created_at < {AS_OF} - INTERVAL 90 DAY AND alignment_status <> 'archived'")
    return t.clusters.select("id", F.when(old, "archived").otherwise(F.col("alignment_status")).alias("status"))


@query("st10_cascading_delete", f"SELECT m.pain_event_id FROM emb_now m WHERE NOT EXISTS (SELECT 1 FROM events_now e WHERE e.id = m.pain_event_id AND e.cluster_id IS NULL AND coalesce(e.orphan_since, {_AS_OF}) < {_AS_OF} - INTERVAL 14 DAY)")
def st10(t):
    gone = t.events("cluster_id", "orphan_since").filter(f"cluster_id IS NULL AND coalesce(orphan_since, {AS_OF}) < {AS_OF} - INTERVAL 14 DAY")
    return t.embeddings().select("pain_event_id").join(gone.select(F.col("id").alias("pain_event_id")), "pain_event_id", "left_anti")


@query("st14_resume", "SELECT id FROM events_now e WHERE cluster_id IS NULL AND EXISTS (SELECT 1 FROM emb_now m WHERE m.pain_event_id = e.id)")
def st14(t):
    return t.events("cluster_id").filter("cluster_id IS NULL").select("id").join(t.embeddings().select(F.col("pain_event_id").alias("id")), "id", "left_semi")


@query("w_tumbling_counts", "SELECT CAST(date_trunc('day', extracted_at) AS VARCHAR) AS day, count(*) AS n, round(avg(extraction_confidence) + 1e-9, 6) AS confidence FROM events_now WHERE extracted_at IS NOT NULL GROUP BY 1")
def tumbling(t):
    """An extension: events per day by a tumbling window."""
    e = t.events("extracted_at", "extraction_confidence").filter("extracted_at IS NOT NULL")
    g = e.groupBy(F.window(F.col("extracted_at").cast("timestamp_ntz"), "1 day").alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("extraction_confidence") + 1e-9, 6).alias("confidence")).select(F.col("w.start").cast("string").alias("day"), "n", "confidence")


@query("m01_schema_evolution", "SELECT id, cluster_size, 'unknown' AS owner, 0 AS version FROM clusters", now=False)
def m01(t):
    return evolve(t.raw("clusters", "id", "cluster_size"), {"owner": ("string", "unknown"), "version": ("int", 0), "cluster_size": ("int", 0)})


@query("m02_backfill_trust", "SELECT id, coalesce(trust_level, CASE category WHEN 'core' THEN 0.9 WHEN 'secondary' THEN 0.7 WHEN 'verticals' THEN 0.6 WHEN 'experimental' THEN 0.4 ELSE 0.5 END) AS trust FROM posts_now")
def m02(t):
    by = F.create_map(*[F.lit(x) for kv in {"core": 0.9, "secondary": 0.7, "verticals": 0.6, "experimental": 0.4}.items() for x in kv])
    return t.posts("trust_level", "category").select("id", F.coalesce("trust_level", F.try_element_at(by, F.coalesce("category", F.lit(""))), F.lit(0.5)).alias("trust"))


@query("m03_backfill_similarity", "SELECT id, coalesce(workflow_similarity, 0) AS similarity FROM clusters", now=False)
def m03(t):
    return t.clusters.select("id", F.coalesce("workflow_similarity", F.lit(0.0)).alias("similarity"))


@query("m04_backfill_lifecycle", "SELECT id, CASE WHEN cluster_id IS NOT NULL THEN 'active' ELSE 'orphan' END AS stage FROM events_now")
def m04(t):
    return t.events("cluster_id").select("id", F.when(F.col("cluster_id").isNotNull(), "active").otherwise("orphan").alias("stage"))


@query("m06_dedup_clusters", "SELECT o.id FROM opportunities o JOIN (SELECT max(id) AS id FROM clusters GROUP BY lower(trim(coalesce(cluster_name, '')))) k ON k.id = o.cluster_id", now=False)
def m06(t):
    keep = t.clusters.groupBy(F.lower(F.trim(F.coalesce("cluster_name", F.lit("")))).alias("n")).agg(F.max("id").alias("cluster_id")).select("cluster_id")
    return t.opportunities.join(keep, "cluster_id", "left_semi").select("id")


@query("m07_dedup_events", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY post_id, problem ORDER BY id) AS r FROM events_now) WHERE r = 1")
def m07(t):
    r = F.row_number().over(Window.partitionBy("post_id", "problem").orderBy("id"))
    return t.events("post_id", "problem").withColumn("r", r).filter("r = 1").select("id")


@query("m08_source_purge", "SELECT id FROM posts_now WHERE lower(trim(source)) <> 'hackernews' OR source IS NULL")
def m08(t):
    return t.posts("source").filter("lower(trim(source)) <> 'hackernews' OR source IS NULL").select("id")


@query("m11_store_consistency", "SELECT coalesce(e.id, m.pain_event_id) AS id, CASE WHEN e.id IS NULL THEN 'no event' ELSE 'no vector' END AS issue FROM events_now e FULL JOIN emb_now m ON m.pain_event_id = e.id WHERE e.id IS NULL OR m.pain_event_id IS NULL")
def m11(t):
    e = t.events().select("id")
    m = t.embeddings().select(F.col("pain_event_id").alias("mid"))
    both = e.join(m, F.col("id") == F.col("mid"), "full").filter("id IS NULL OR mid IS NULL")
    return both.select(F.coalesce("id", "mid").alias("id"), F.when(F.col("id").isNull(), "no event").otherwise("no vector").alias("issue"))
