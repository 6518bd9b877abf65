"""Windows, sorts, limits, top-k."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.catalog.base import query


@query("w01_best_per_cluster", "SELECT cluster_id, id, raw_total_score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY raw_total_score DESC NULLS LAST, id DESC) AS r FROM opportunities) WHERE r = 1", now=False)
def w01(t):
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("raw_total_score"), F.desc("id")))
    return t.opportunities.withColumn("r", r).filter("r = 1").select("cluster_id", "id", "raw_total_score")


_SNAPSHOTS = "s AS (SELECT c_custkey AS id, c_custkey % 140 AS cluster_id, (c_custkey * 11) % 740 AS hour, CAST((c_custkey * 5) % 30 AS INT) AS size, CAST((c_custkey * 3) % 20 AS INT) AS authors, CAST(c_custkey % 8 AS INT) AS subs FROM customer)"


def snapshots(t):
    """A snapshot history derived from the customer table: (id, cluster_id, hour, size, authors, subs)."""
    k = F.col("c_custkey")
    return t.raw("customer", "c_custkey").select(k.alias("id"), (k % 140).alias("cluster_id"), ((k * 11) % 740).alias("hour"), ((k * 5) % 30).cast("int").alias("size"), ((k * 3) % 20).cast("int").alias("authors"), (k % 8).cast("int").alias("subs"))


@query("w02_latest_snapshot", f"WITH {_SNAPSHOTS} SELECT cluster_id, id, size FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY hour DESC, id DESC) AS r FROM s) WHERE r = 1", now=False)
def w02(t):
    best = F.max_by(F.struct("id", "size"), F.struct("hour", "id")).alias("m")
    return snapshots(t).groupBy("cluster_id").agg(best).select("cluster_id", "m.id", "m.size")


@query("w03_delta_to_previous", f"WITH {_SNAPSHOTS} SELECT id, size - lag(size) OVER w AS grown, hour - lag(hour) OVER w AS hours FROM s WINDOW w AS (PARTITION BY cluster_id ORDER BY hour, id)", now=False)
def w03(t):
    w = Window.partitionBy("cluster_id").orderBy("hour", "id")
    return snapshots(t).select("id", (F.col("size") - F.lag("size").over(w)).alias("grown"), (F.col("hour") - F.lag("hour").over(w)).alias("hours"))


@query("w04_priority_sort", "SELECT id, row_number() OVER (PARTITION BY semantic_category ORDER BY CASE WHEN cluster_size >= 40 THEN 2 WHEN cluster_size >= 20 THEN 1 ELSE 0 END DESC, product_impact DESC NULLS LAST, id) AS place FROM clusters", now=False)
def w04(t):
    level = F.when(F.col("cluster_size") >= 40, 2).when(F.col("cluster_size") >= 20, 1).otherwise(0)
    w = Window.partitionBy("semantic_category").orderBy(level.desc(), F.desc_nulls_last("product_impact"), "id")
    return t.clusters.select("id", F.row_number().over(w).alias("place"))


@query("w05_top_candidates", "SELECT id, total_score FROM opportunities WHERE total_score IS NOT NULL ORDER BY total_score DESC, id LIMIT 5", now=False)
def w05(t):
    return t.opportunities.filter("total_score IS NOT NULL").select("id", "total_score").orderBy(F.desc("total_score"), "id").limit(5)


@query("w07_top20_per_cluster", "SELECT cluster_id, id FROM (SELECT e.cluster_id, e.id, row_number() OVER (PARTITION BY e.cluster_id ORDER BY f.pain_score DESC NULLS LAST, e.id) AS r FROM events_now e JOIN filtered_now f ON f.id = e.post_id WHERE e.cluster_id IS NOT NULL) WHERE r <= 20")
def w07(t):
    f = t.filtered("pain_score").select(F.col("id").alias("post_id"), "pain_score")
    e = t.events("cluster_id", "post_id").filter("cluster_id IS NOT NULL").join(f, "post_id")
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("pain_score"), "id"))
    return e.withColumn("r", r).filter("r <= 20").select("cluster_id", "id")


@query("w11_first_k_sample", "SELECT cluster_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM events_now WHERE cluster_id IS NOT NULL) WHERE r <= 5 GROUP BY 1")
def w11(t):
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))
    e = t.events("cluster_id").filter("cluster_id IS NOT NULL").withColumn("r", r).filter("r <= 5")
    return e.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("w12_top_categories", "SELECT category, n FROM (SELECT category, count(*) AS n FROM posts_now WHERE category IS NOT NULL GROUP BY 1) ORDER BY n DESC, category LIMIT 10")
def w12(t):
    return t.posts("category").filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("w13_newest_rows", "SELECT id FROM events_now ORDER BY extracted_at DESC NULLS LAST, id DESC LIMIT 5")
def w13(t):
    return t.events("extracted_at").orderBy(F.desc_nulls_last("extracted_at"), F.desc("id")).limit(5).select("id")
