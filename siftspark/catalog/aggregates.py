"""Aggregations and set operations."""

from pyspark.sql import functions as F

from siftspark.catalog.base import query
from siftspark.functions import lexicons as L
from siftspark.functions import text as X


def _n():
    return F.count(F.lit(1))


def _freq_sql(column):
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{k}') THEN {v}" for k, v in L.FREQUENCY.items()) + f" ELSE {L.FREQUENCY_DEFAULT} END"


@query("g01_table_counts", "SELECT 'posts' AS t, count(*) AS n FROM posts UNION ALL SELECT 'filtered_posts', count(*) FROM filtered_posts UNION ALL SELECT 'pain_events', count(*) FROM pain_events UNION ALL SELECT 'clusters', count(*) FROM clusters UNION ALL SELECT 'opportunities', count(*) FROM opportunities", now=False)
def g01(t):
    out = None
    for name in ("posts", "filtered_posts", "pain_events", "clusters", "opportunities"):
        one = t.raw(name).select(F.lit(name).alias("t")).groupBy("t").agg(_n().alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g02_group_by_source", "SELECT source, count(*) AS n FROM posts GROUP BY source", now=False)
def g02(t):
    return t.raw("posts", "source").groupBy("source").agg(_n().alias("n"))


@query("g03_distinct_per_cluster", "SELECT e.cluster_id, count(DISTINCT f.author) AS authors, count(DISTINCT f.subreddit) AS subreddits FROM events_now e JOIN filtered_now f ON f.id = e.post_id WHERE e.cluster_id IS NOT NULL GROUP BY 1")
def g03(t):
    f = t.filtered("author", "subreddit").select(F.col("id").alias("post_id"), "author", "subreddit")
    e = t.events("cluster_id", "post_id").filter("cluster_id IS NOT NULL").select("cluster_id", "post_id").distinct()
    return e.join(f, "post_id").groupBy("cluster_id").agg(F.countDistinct("author").alias("authors"), F.countDistinct("subreddit").alias("subreddits"))


@query("g04_average_trust", "SELECT e.cluster_id, round(coalesce(nullif(avg(p.trust_level), 0), 0.5) + 1e-9, 6) AS trust FROM events_now e JOIN posts_now p ON p.id = e.post_id WHERE e.cluster_id IS NOT NULL GROUP BY 1")
def g04(t):
    p = t.posts("trust_level").select(F.col("id").alias("post_id"), "trust_level")
    e = t.events("cluster_id", "post_id").filter("cluster_id IS NOT NULL")
    return e.join(p, "post_id").groupBy("cluster_id").agg(F.round(F.coalesce(F.nullif(F.avg("trust_level"), F.lit(0.0)), F.lit(0.5)) + 1e-9, 6).alias("trust"))


@query("g05_mean_frequency", f"SELECT cluster_id, round(avg({_freq_sql('frequency')}) + 1e-9, 6) AS frequency FROM events_now WHERE cluster_id IS NOT NULL GROUP BY 1")
def g05(t):
    e = t.events("cluster_id", "frequency").filter("cluster_id IS NOT NULL")
    score = X.first_score(F.col("frequency"), L.FREQUENCY, L.FREQUENCY_DEFAULT)
    return e.groupBy("cluster_id").agg(F.round(F.avg(score) + 1e-9, 6).alias("frequency"))


@query("g06_latest_event", "SELECT cluster_id, CAST(max(extracted_at) AS VARCHAR) AS latest FROM events_now GROUP BY 1")
def g06(t):
    return t.events("cluster_id", "extracted_at").groupBy("cluster_id").agg(F.max("extracted_at").cast("string").alias("latest"))


@query("g07_cluster_metrics", f"SELECT c.id, count(e.id) AS size, count(DISTINCT f.author) AS authors, count(DISTINCT f.subreddit) AS subreddits, round(avg(CASE WHEN e.id IS NOT NULL THEN {_freq_sql('e.frequency')} END) + 1e-9, 6) AS frequency FROM clusters c LEFT JOIN events_now e ON e.cluster_id = c.id LEFT JOIN filtered_now f ON f.id = e.post_id GROUP BY 1")
def g07(t):
    m = cluster_metrics(t)
    return m.select("id", "size", "authors", "subreddits", F.round(F.col("frequency") + 1e-9, 6).alias("frequency"))


def cluster_metrics(t):
    """(id, size, authors, subreddits, frequency, latest) of every cluster by its current events; zeros and nulls for one without."""
    f = t.filtered("author", "subreddit").select(F.col("id").alias("post_id"), "author", "subreddit")
    e = t.events("cluster_id", "post_id", "frequency", "extracted_at").withColumn("score", X.first_score(F.col("frequency"), L.FREQUENCY, L.FREQUENCY_DEFAULT))
    e = e.filter("cluster_id IS NOT NULL").join(f, "post_id", "left").groupBy(F.col("cluster_id").alias("id"))
    m = e.agg(_n().alias("size"), F.countDistinct("author").alias("authors"), F.countDistinct("subreddit").alias("subreddits"), F.avg("score").alias("frequency"), F.max("extracted_at").alias("latest"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return t.clusters.select("id").join(m, "id", "left").select("id", zero("size"), zero("authors"), zero("subreddits"), "frequency", "latest")


@query("g08_group_concat_having", "SELECT cluster_id, count(*) AS n, max(total_score) AS best, string_agg(opportunity_name, ', ' ORDER BY opportunity_name) AS names FROM opportunities WHERE opportunity_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 2", now=False)
def g08(t):
    g = t.opportunities.filter("opportunity_name IS NOT NULL").groupBy("cluster_id")
    names = F.array_join(F.sort_array(F.collect_list("opportunity_name")), ", ")
    return g.agg(_n().alias("n"), F.max("total_score").alias("best"), names.alias("names")).filter("n >= 2")


@query("g09_bucket_histogram", "SELECT CASE WHEN workflow_similarity >= 0.8 THEN 'high' WHEN workflow_similarity >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM clusters GROUP BY 1", now=False)
def g09(t):
    s = F.col("workflow_similarity")
    return t.clusters.groupBy(F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low").alias("bucket")).agg(_n().alias("n"))


@query("g10_multi_stat", "SELECT count(total_score) AS n, round(avg(total_score) + 1e-9, 6) AS mean, min(total_score) AS low, max(total_score) AS high FROM opportunities WHERE total_score > 0", now=False)
def g10(t):
    s = "total_score"
    return t.opportunities.filter("total_score > 0").agg(F.count(s).alias("n"), F.round(F.avg(s) + 1e-9, 6).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high"))


@query("g11_count_avg_by_source", "SELECT source_type, count(*) AS n, round(avg(cluster_size) + 1e-9, 6) AS mean FROM clusters GROUP BY 1", now=False)
def g11(t):
    return t.clusters.groupBy("source_type").agg(_n().alias("n"), F.round(F.avg("cluster_size") + 1e-9, 6).alias("mean"))


@query("g12_semantic_category", "SELECT semantic_category, count(*) AS n, round(avg(product_impact) + 1e-9, 6) AS impact, CAST(sum(cluster_size) AS BIGINT) AS events FROM clusters WHERE semantic_category <> '' GROUP BY 1", now=False)
def g12(t):
    g = t.clusters.filter("semantic_category <> ''").groupBy("semantic_category")
    return g.agg(_n().alias("n"), F.round(F.avg("product_impact") + 1e-9, 6).alias("impact"), F.sum("cluster_size").cast("long").alias("events"))


@query("g13_nested_aggregate", "SELECT round(avg(n) + 1e-9, 6) AS mean FROM (SELECT post_id, count(*) AS n FROM events_now GROUP BY 1)")
def g13(t):
    return t.events("post_id").groupBy("post_id").agg(_n().alias("n")).agg(F.round(F.avg("n") + 1e-9, 6).alias("mean"))


@query("g14_distinct_via_join", "SELECT count(DISTINCT p.id) AS n FROM posts p JOIN pain_events e ON e.post_id = p.id", now=False)
def g14(t):
    p = t.raw("posts", "id").distinct().join(t.raw("pain_events", "post_id").select(F.col("post_id").alias("id")), "id", "left_semi")
    return p.agg(_n().alias("n"))


@query("g15_duplicate_groups", "SELECT lower(trim(cluster_name)) AS name, count(*) AS n, max(id) AS keep, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM clusters WHERE cluster_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1", now=False)
def g15(t):
    g = t.clusters.filter("cluster_name IS NOT NULL").groupBy(F.lower(F.trim("cluster_name")).alias("name"))
    return g.agg(_n().alias("n"), F.max("id").alias("keep"), F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids")).filter("n > 1")


@query("g16_duplicate_sources", "SELECT source_id, count(*) AS n, CAST(min(extracted_at) AS VARCHAR) AS first FROM pain_events WHERE source_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1", now=False)
def g16(t):
    g = t.raw("pain_events", "source_id", "extracted_at").filter("source_id IS NOT NULL").groupBy("source_id")
    return g.agg(_n().alias("n"), F.min("extracted_at").cast("string").alias("first")).filter("n > 1")


@query("g17_duplicate_opportunities", "SELECT cluster_id, count(*) - 1 AS surplus FROM opportunities GROUP BY 1 HAVING count(*) > 1", now=False)
def g17(t):
    return t.opportunities.groupBy("cluster_id").agg((_n() - 1).alias("surplus")).filter("surplus > 0")


@query("g18_conditional_sum", "SELECT CAST(sum(CASE WHEN trim(coalesce(centroid_summary, '')) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS summarised, count(*) AS n FROM clusters", now=False)
def g18(t):
    return t.clusters.agg(F.count_if(F.trim(F.coalesce("centroid_summary", F.lit(""))) != "").alias("summarised"), _n().alias("n"))


@query("g19_filtered_count_share", "SELECT source_type, count(*) AS n, count(*) FILTER (WHERE cluster_id IS NOT NULL) AS clustered, round(100.0 * count(*) FILTER (WHERE cluster_id IS NOT NULL) / count(*), 1) AS pct FROM events_now GROUP BY 1")
def g19(t):
    k = F.count_if(F.col("cluster_id").isNotNull())
    return t.events("source_type", "cluster_id").groupBy("source_type").agg(_n().alias("n"), k.alias("clustered"), F.round(F.lit(100.0) * k / _n(), 1).alias("pct"))


@query("g20_percent_of_total", "SELECT b AS bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM (SELECT CASE WHEN pain_score >= 0.8 THEN 'excellent' WHEN pain_score >= 0.5 THEN 'good' WHEN pain_score IS NULL THEN 'none' ELSE 'low' END AS b FROM filtered_now) GROUP BY 1")
def g20(t):
    from pyspark.sql import Window

    s = F.col("pain_score")
    g = t.filtered("pain_score").groupBy(F.when(s >= 0.8, "excellent").when(s >= 0.5, "good").when(s.isNull(), "none").otherwise("low").alias("bucket")).agg(_n().alias("n"))
    # the window runs over the four buckets only
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


@query("g21_median", "SELECT pass_type, round(median(pain_score), 6) AS median FROM filtered_now WHERE pain_score IS NOT NULL AND NOT isnan(pain_score) GROUP BY 1")
def g21(t):
    f = t.filtered("pass_type", "pain_score").filter("pain_score IS NOT NULL AND NOT isnan(pain_score)")
    return f.groupBy("pass_type").agg(F.round(F.median("pain_score"), 6).alias("median"))


@query("g22_keyword_histogram", "SELECT k AS keyword, count(*) AS n FROM (SELECT unnest(pain_keywords) AS k FROM filtered_now) WHERE k IS NOT NULL GROUP BY 1")
def g22(t):
    return t.filtered("pain_keywords").select(F.explode("pain_keywords").alias("keyword")).filter("keyword IS NOT NULL").groupBy("keyword").agg(_n().alias("n"))


@query("g24_tool_counts", "SELECT cluster_id, tool, count(*) AS n FROM (SELECT cluster_id, unnest(from_json(mentioned_tools, '[\"VARCHAR\"]')) AS tool FROM events_now WHERE cluster_id IS NOT NULL AND json_valid(mentioned_tools)) GROUP BY 1, 2")
def g24(t):
    e = t.events("cluster_id", "mentioned_tools").filter("cluster_id IS NOT NULL")
    tools = e.select("cluster_id", F.explode(F.from_json("mentioned_tools", "array<string>")).alias("tool"))
    return tools.groupBy("cluster_id", "tool").agg(_n().alias("n"))


@query("g28_tier_counts", "SELECT count(*) FILTER (WHERE total_score >= 8.5) AS top, count(*) FILTER (WHERE total_score >= 7 AND total_score < 8.5) AS good, count(*) FILTER (WHERE total_score >= 5 AND total_score < 7) AS fair, round(avg(total_score) + 1e-9, 6) AS mean FROM opportunities", now=False)
def g28(t):
    s = F.col("total_score")
    return t.opportunities.agg(F.count_if(s >= 8.5).alias("top"), F.count_if((s >= 7) & (s < 8.5)).alias("good"), F.count_if((s >= 5) & (s < 7)).alias("fair"), F.round(F.avg(s) + 1e-9, 6).alias("mean"))


@query("g32_threshold_counts", "SELECT min(num_comments) AS low, max(num_comments) AS high, round(avg(num_comments) + 1e-9, 6) AS mean, count(*) FILTER (WHERE score >= 10 AND length(body) >= 30) AS strong FROM posts_now")
def g32(t):
    c = "num_comments"
    strong = F.count_if((F.col("score") >= 10) & (F.length("body") >= 30))
    return t.posts("num_comments", "score", "body").agg(F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c) + 1e-9, 6).alias("mean"), strong.alias("strong"))


@query("g35_opportunities_per_cluster", "SELECT c.cluster_name, c.cluster_size, count(*) AS n FROM clusters c JOIN opportunities o ON o.cluster_id = c.id GROUP BY c.id, c.cluster_name, c.cluster_size", now=False)
def g35(t):
    o = t.opportunities.groupBy(F.col("cluster_id").alias("id")).agg(_n().alias("n"))
    return t.clusters.join(o, "id").select("cluster_name", "cluster_size", "n")


@query("g38_distinct_against_count", "SELECT count(*) AS n, count(DISTINCT source_id) AS sources FROM pain_events", now=False)
def g38(t):
    return t.raw("pain_events", "source_id").agg(_n().alias("n"), F.countDistinct("source_id").alias("sources"))


@query("g41_null_as_default_count", "SELECT count(*) AS n FROM events_now WHERE coalesce(source_type, 'post') = 'post'")
def g41(t):
    return t.events("source_type").agg(F.count_if(F.coalesce("source_type", F.lit("post")) == "post").alias("n"))


@query("s01_keeper_union", "SELECT max(id) AS id FROM opportunities WHERE total_score > 0 GROUP BY cluster_id UNION SELECT max(id) FROM opportunities GROUP BY cluster_id", now=False)
def s01(t):
    pick = lambda df: df.groupBy("cluster_id").agg(F.max("id").alias("id")).select("id")
    return pick(t.opportunities.filter("total_score > 0")).union(pick(t.opportunities)).distinct()


@query("s02_labelled_counts", "SELECT 'posts' AS what, count(*) AS n FROM posts_now UNION ALL SELECT 'filtered', count(*) FROM filtered_now UNION ALL SELECT 'events', count(*) FROM events_now")
def s02(t):
    one = lambda df, name: df.agg(_n().alias("n")).select(F.lit(name).alias("what"), "n")
    return one(t.posts(), "posts").unionByName(one(t.filtered(), "filtered")).unionByName(one(t.events(), "events"))


@query("s06_virtual_rows", "SELECT id, cluster_size AS size, 'cluster' AS kind FROM clusters UNION ALL SELECT cluster_id, CAST(count(*) AS INT), 'virtual' FROM events_now WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def s06(t):
    real = t.clusters.select("id", F.col("cluster_size").alias("size"), F.lit("cluster").alias("kind"))
    virtual = t.events("cluster_id").filter("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("id")).agg(_n().cast("int").alias("size")).withColumn("kind", F.lit("virtual"))
    return real.unionByName(virtual, allowMissingColumns=True)


@query("s07_distinct_projection", "SELECT DISTINCT post_id FROM pain_events WHERE post_id IS NOT NULL", now=False)
def s07(t):
    return t.raw("pain_events", "post_id").filter("post_id IS NOT NULL").distinct()
