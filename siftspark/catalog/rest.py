"""Operators that complete the inventory: roll-ups, set unions as rows, two-phase limits, metadata merges, repairs and flags."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.catalog.base import query, values
from siftspark.functions import lexicons as L
from siftspark.functions import text as X


def _n():
    return F.count(F.lit(1))


#: Stage metrics derived from orders: stage, tokens of prompt and completion, seconds.
_STAGES = "s AS (SELECT o_orderpriority AS stage, o_custkey % 900 AS prompt, o_custkey % 300 AS completion, o_orderkey % 7 AS seconds FROM orders)"


def _stages(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.raw("orders", "o_orderkey", "o_custkey", "o_orderpriority").select(F.col("o_orderpriority").alias("stage"), (c % 900).alias("prompt"), (c % 300).alias("completion"), (k % 7).alias("seconds"))


@query("g30_performance_rollup", f"WITH {_STAGES}, g AS (SELECT stage, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, CAST(sum(seconds) AS BIGINT) AS seconds FROM s GROUP BY 1) SELECT *, round(prompt / 1000.0 * 0.001 + completion / 1000.0 * 0.002, 6) AS cost, round(calls / greatest(seconds, 1), 6) AS throughput, seconds = max(seconds) OVER () AS slowest FROM g", now=False)
def g30(t):
    """Calls, tokens, seconds, cost, throughput and the slowest stage. Stage metrics are derived from orders."""
    g = _stages(t).groupBy("stage").agg(_n().alias("calls"), *[F.sum(c).alias(c) for c in ("prompt", "completion", "seconds")])
    cost = F.col("prompt") / 1000 * 0.001 + F.col("completion") / 1000 * 0.002
    most = F.max("seconds").over(Window.partitionBy(F.lit(1)))  # over the few stages only
    return g.select("*", F.round(cost, 6).alias("cost"), F.round(F.col("calls") / F.greatest("seconds", F.lit(1)), 6).alias("throughput"), (F.col("seconds") == most).alias("slowest"))


@query("g34_efficiency_rates", "SELECT round(p / greatest(d, 1), 6) AS posts_per_day, round(e / greatest(d, 1), 6) AS events_per_day FROM (SELECT count(*) AS p, count(DISTINCT CAST(collected_at AS DATE)) AS d FROM posts_now), (SELECT count(*) AS e FROM events_now)")
def g34(t):
    """Posts and events a day of collection, with a guard for none."""
    p = t.posts().agg(_n().alias("p"), F.countDistinct(F.to_date("collected_at")).alias("d"))
    e = t.events().agg(_n().alias("e"))
    both = p.crossJoin(e)  # one row each
    d = F.greatest("d", F.lit(1))
    return both.select(F.round(F.col("p") / d, 6).alias("posts_per_day"), F.round(F.col("e") / d, 6).alias("events_per_day"))


_BAND = "CASE WHEN pain_score >= 0.8 THEN 'excellent' WHEN pain_score >= 0.6 THEN 'good' WHEN pain_score >= 0.4 THEN 'fair' ELSE 'poor' END"


@query("g36_quality_buckets", f"SELECT b AS bucket, min(pain_score) AS low, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM (SELECT pain_score, {_BAND} AS b FROM filtered_now WHERE pain_score BETWEEN 0 AND 1) GROUP BY 1 ORDER BY low")
def g36(t):
    """Posts by quality, with their least score and share, in the order of that score."""
    g = t.filtered("pain_score").filter("pain_score BETWEEN 0 AND 1").groupBy(F.expr(_BAND).alias("bucket")).agg(F.min("pain_score").alias("low"), _n().alias("n"))
    every = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the four buckets only
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / every, 2)).orderBy("low")


@query("g37_duplicate_group_count", "SELECT (SELECT count(*) FROM (SELECT cluster_id FROM opportunities GROUP BY 1 HAVING count(*) > 1)) AS groups, (SELECT count(*) FROM events_now WHERE cluster_id IS NULL) AS unclustered")
def g37(t):
    """Clusters with several opportunities, and unclustered events."""
    g = t.opportunities.groupBy("cluster_id").agg(_n().alias("k")).filter("k > 1").agg(_n().alias("groups"))
    return g.crossJoin(t.events("cluster_id").filter("cluster_id IS NULL").agg(_n().alias("unclustered")))  # one row each


@query("g39_stage_rates", "SELECT round(c / greatest(e, 1), 6) AS clustering_rate, round(o / greatest(k, 1), 6) AS opportunity_rate, round(v / greatest(o, 1), 6) AS viable_rate, round(s / greatest(e, 1), 6) AS success_rate, round(m / greatest(e, 1), 6) AS processing_rate FROM (SELECT count(*) AS e, count(cluster_id) AS c, count(*) FILTER (WHERE extraction_confidence >= 0.5) AS s, count(m.pain_event_id) AS m FROM events_now LEFT JOIN emb_now m ON m.pain_event_id = id), (SELECT count(*) AS k FROM clusters), (SELECT count(*) AS o, count(*) FILTER (WHERE total_score >= 7) AS v FROM opportunities)")
def g39(t):
    """Shares of events clustered, sure and embedded, of opportunities a cluster, and of viable opportunities, with guards for none."""
    m = t.embeddings().select(F.col("pain_event_id").alias("id"), F.lit(1).alias("m"))
    e = t.events("cluster_id", "extraction_confidence").join(m, "id", "left")
    e = e.agg(_n().alias("e"), F.count("cluster_id").alias("c"), F.count_if(F.col("extraction_confidence") >= 0.5).alias("s"), F.count("m").alias("m"))
    all_ = e.crossJoin(t.clusters.agg(_n().alias("k"))).crossJoin(t.opportunities.agg(_n().alias("o"), F.count_if(F.col("total_score") >= 7).alias("v")))  # one row each
    rate = lambda a, b, name: F.round(F.col(a) / F.greatest(b, F.lit(1)), 6).alias(name)
    return all_.select(rate("c", "e", "clustering_rate"), rate("o", "k", "opportunity_rate"), rate("v", "o", "viable_rate"), rate("s", "e", "success_rate"), rate("m", "e", "processing_rate"))


@query("s03_sorted_id_union", "SELECT post_id, id FROM pain_events WHERE post_id IS NOT NULL AND cluster_id IS NULL AND id IS NOT NULL UNION SELECT post_id, id FROM pain_events WHERE post_id IS NOT NULL AND extraction_confidence >= 0.5 AND id IS NOT NULL", now=False)
def s03(t):
    """The union of two id lists of every post (unclustered and sure events), one row an id, so that no list has to fit a row."""
    e = t.raw("pain_events", "post_id", "id", "cluster_id", "extraction_confidence").filter("post_id IS NOT NULL AND id IS NOT NULL")
    return e.filter("cluster_id IS NULL OR extraction_confidence >= 0.5").select("post_id", "id").distinct()


@query("s04_append_if_absent", "SELECT o.cluster_id, array_to_string(list_sort(list_distinct(list(o.id) || [o.cluster_id])), ',') AS ids FROM opportunities o WHERE o.cluster_id IS NOT NULL GROUP BY 1", now=False)
def s04(t):
    """The sorted ids of every cluster's opportunities with the cluster's own id put in if it is not there yet; a cluster has a handful of opportunities."""
    g = t.opportunities.filter("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.collect_list("id").alias("ids"))
    return g.select("cluster_id", F.array_join(F.array_sort(F.array_union("ids", F.array("cluster_id"))).cast("array<string>"), ",").alias("ids"))


@query("s05_equal_sets", "WITH s AS (SELECT post_id, list_sort(list(DISTINCT mentioned_tools)) AS s FROM pain_events WHERE post_id IS NOT NULL AND mentioned_tools IS NOT NULL GROUP BY 1) SELECT post_id, min(post_id) OVER (PARTITION BY s) AS class FROM s", now=False)
def s05(t):
    """Posts with the class of their set of mentioned tools: the least post with the very same set. Sets are told apart by size and two 64-bit sums of hashes, partially aggregated."""
    e = t.raw("pain_events", "post_id", "mentioned_tools").filter("post_id IS NOT NULL AND mentioned_tools IS NOT NULL").distinct()
    half = lambda seed: F.sum((F.xxhash64("mentioned_tools", F.lit(seed)) / F.lit(2.0**20)).cast("long"))
    s = e.groupBy("post_id").agg(_n().alias("n"), half(1).alias("h1"), half(2).alias("h2"))
    least = s.groupBy("n", "h1", "h2").agg(F.min("post_id").alias("class"))
    return s.join(least, ["n", "h1", "h2"]).select("post_id", "class")


@query("w08_two_phase_limit", "SELECT id FROM (SELECT id, extracted_at FROM events_now ORDER BY extracted_at DESC NULLS LAST, id DESC LIMIT 200) e WHERE NOT EXISTS (SELECT 1 FROM emb_now m WHERE m.pain_event_id = e.id) ORDER BY extracted_at DESC NULLS LAST, id DESC LIMIT 100")
def w08(t):
    """Of the 200 newest events the first 100 that have no vector yet: a limit, an anti-join and a limit."""
    order = [F.desc_nulls_last("extracted_at"), F.desc("id")]
    newest = t.events("extracted_at").select("id", "extracted_at").orderBy(*order).limit(200)
    have = t.embeddings().select(F.col("pain_event_id").alias("id"))
    return newest.join(have, "id", "left_anti").orderBy(*order).limit(100).select("id")


@query("j18_posts_comments", "SELECT p.id, e.id AS comment, p.score FROM posts_now p JOIN events_now e ON e.post_id = p.id WHERE e.source_type = 'comment' AND p.score IS NOT NULL ORDER BY p.score DESC, e.id LIMIT 10")
def j18(t):
    """The 10 comments under the posts of highest score; events from comments stand for comments."""
    p = t.posts("score").filter("score IS NOT NULL").select(F.col("id").alias("post_id"), "score")
    e = t.events("post_id", "source_type").filter("source_type = 'comment'").select(F.col("id").alias("comment"), "post_id")
    return p.join(e, "post_id").select(F.col("post_id").alias("id"), "comment", "score").orderBy(F.desc("score"), "comment").limit(10)


@query("snk05_metadata_merge", "SELECT m.pain_event_id AS id, coalesce(e.lifecycle_stage, 'unknown') AS stage, coalesce(e.cluster_id, -1) AS cluster_id, m.embedding_model AS model FROM emb_now m LEFT JOIN events_now e ON e.id = m.pain_event_id UNION ALL SELECT e.id, coalesce(e.lifecycle_stage, 'unknown'), coalesce(e.cluster_id, -1), NULL FROM events_now e WHERE NOT EXISTS (SELECT 1 FROM emb_now m WHERE m.pain_event_id = e.id)")
def snk05_merge(t):
    """The vector store after adding missing ids and merging metadata field by field: an update's value if it has one, else the old."""
    store = t.embeddings("embedding_model").select(F.col("pain_event_id").alias("id"), F.create_map(F.lit("stage"), F.lit("unknown"), F.lit("cluster_id"), F.lit("-1")).alias("old"), F.col("embedding_model").alias("model"))
    update = t.events("lifecycle_stage", "cluster_id").select("id", F.map_filter(F.create_map(F.lit("stage"), F.col("lifecycle_stage"), F.lit("cluster_id"), F.col("cluster_id").cast("string")), lambda k, v: v.isNotNull()).alias("new"))
    both = store.join(update, "id", "full")
    default = F.create_map(F.lit("stage"), F.lit("unknown"), F.lit("cluster_id"), F.lit("-1"))
    field = lambda name: F.coalesce(F.col("new")[name], F.col("old")[name], default[name])
    return both.select("id", field("stage").alias("stage"), field("cluster_id").cast("long").alias("cluster_id"), "model")


@query("snk09_versioned_update", "SELECT id, CASE WHEN raw_total_score >= 5 THEN raw_total_score ELSE total_score END AS total_score, CASE WHEN raw_total_score >= 5 THEN 2 ELSE 1 END AS version, CASE WHEN raw_total_score >= 5 THEN 1 ELSE 0 END AS rescore_count, CASE WHEN raw_total_score >= 5 THEN '{\"cluster\":' || coalesce(CAST(cluster_id AS VARCHAR), 'null') || ',\"trusted\":' || CASE WHEN trust_level >= 0.5 THEN 'true' ELSE 'false' END || '}' END AS breakdown FROM opportunities", now=False)
def snk09(t):
    """Opportunities after an update of scores: version and number of rescorings raised, and the breakdown as JSON, where there is a new score."""
    new = F.col("raw_total_score") >= 5
    trusted = F.coalesce(F.col("trust_level") >= 0.5, F.lit(False))
    breakdown = F.to_json(F.struct(F.col("cluster_id").alias("cluster"), trusted.alias("trusted")), {"ignoreNullFields": "false"})
    return t.opportunities.select("id", F.when(new, F.col("raw_total_score")).otherwise(F.col("total_score")).alias("total_score"), F.when(new, 2).otherwise(1).alias("version"), F.when(new, 1).otherwise(0).alias("rescore_count"), F.when(new, breakdown).alias("breakdown"))


_RIVALS = values([(c, k) for c, ks in L.COMPETITORS.items() for k in ks], "k(cat, kw)")


@query("x11_competitors", f"SELECT id, n AS rivals, CASE WHEN n = 0 THEN 'low' WHEN n <= 2 THEN 'medium' ELSE 'high' END AS level, CASE WHEN n = 0 THEN 2 WHEN n <= 2 THEN 5 ELSE 8 END AS score FROM (SELECT o.id, count(k.kw) AS n FROM opportunities o LEFT JOIN {_RIVALS} ON contains(lower(coalesce(o.opportunity_name, '') || ' ' || coalesce(o.description, '') || ' ' || coalesce(o.target_users, '')), k.kw) GROUP BY 1)", now=False)
def x11(t):
    """Competing products named by every opportunity, with the level and score of their number."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("opportunity_name", "description", "target_users")]))
    o = t.opportunities.select("id", text.alias("text"))
    n = F.col("rivals")
    return o.select("id", X.held_count(F.col("text"), [k for ks in L.COMPETITORS.values() for k in ks]).cast("long").alias("rivals")).select("id", "rivals", F.when(n == 0, "low").when(n <= 2, "medium").otherwise("high").alias("level"), F.when(n == 0, 2).when(n <= 2, 5).otherwise(8).alias("score"))


@query("x25_json_repair", r"SELECT id, json_extract_string(r, '$.flair') AS flair, CASE WHEN NOT coalesce(json_valid(r), false) THEN 'no JSON' END AS error FROM (SELECT id, replace(regexp_replace(regexp_extract('Answer: **' || platform_data || '** so far', '\{[^}]*\}'), '[\x00-\x1f]', ' ', 'g'), '**', '') AS r FROM posts_now WHERE platform_data IS NOT NULL)")
def x25(t):
    """JSON cut out of an answer with words and bold marks around it: the outermost braces, control characters as blanks; an error where that is no JSON. Objects are flat here."""
    answer = F.concat(F.lit("Answer: **"), "platform_data", F.lit("** so far"))
    r = F.replace(F.regexp_replace(F.regexp_extract(answer, r"\{[^}]*\}", 0), "[\\x00-\\x1f]", " "), F.lit("**"), F.lit(""))
    p = t.posts("platform_data").filter("platform_data IS NOT NULL").select("id", r.alias("r"))
    ok = F.try_parse_json("r").isNotNull()
    return p.select("id", F.when(ok, F.get_json_object("r", "$.flair")).alias("flair"), F.when(~ok, "no JSON").alias("error"))


_WORKAROUND = ["workaround", "manual", "instead", "still doing"]


@query("x31_workaround_sentence", f"WITH k AS (SELECT * FROM {values(list(enumerate(_WORKAROUND)), 'k(i, kw)')}), s AS (SELECT id, unnest(string_split(context, '.')) AS s, generate_subscripts(string_split(context, '.'), 1) AS n FROM events_now WHERE context IS NOT NULL) SELECT id, trim(arg_min(s, struct_pack(i := k.i, n := s.n))) AS sentence FROM s JOIN k ON contains(lower(s.s), k.kw) GROUP BY 1")
def x31(t):
    """The first sentence with the first keyword of workarounds that any sentence of a context holds."""
    parts = F.split("context", r"\.")

    def with_word(k):
        return F.filter("s", lambda s: F.lower(s).contains(k))

    first = F.coalesce(*[F.try_element_at(with_word(k), F.lit(1)) for k in _WORKAROUND])
    e = t.events("context").select("id", parts.alias("s"))
    return e.select("id", F.trim(first).alias("sentence")).filter("sentence IS NOT NULL")


@query("x33_platform_insights", "SELECT id, coalesce(source_type, 'unknown') || ': ' || substr(coalesce(centroid_summary, ''), 1, 100) AS insight, array_to_string(list_filter([CASE WHEN contains(lower(centroid_summary), 'slack') THEN 'Slack' END, CASE WHEN contains(lower(centroid_summary), 'email') THEN 'Email' END, CASE WHEN contains(lower(centroid_summary), 'discord') THEN 'Discord' END], lambda x: x IS NOT NULL), ',') AS tools FROM clusters", now=False)
def x33(t):
    """What every cluster tells of its platform, and the tools its summary names."""
    low = F.lower("centroid_summary")
    tools = F.concat_ws(",", *[F.when(low.contains(n.lower()), n) for n in ("Slack", "Email", "Discord")])
    return t.clusters.select("id", F.concat(F.coalesce("source_type", F.lit("unknown")), F.lit(": "), F.substring(F.coalesce("centroid_summary", F.lit("")), 1, 100)).alias("insight"), tools.alias("tools"))


@query("m10_migration_counts", "SELECT count(*) AS source, count(*) AS target, true AS same FROM emb_now WHERE embedding_vector IS NOT NULL")
def m10(t):
    """Vectors copied to a table of their own, with both counts."""
    from siftspark.plans.scratch import cut

    rows = t.embeddings("embedding_vector").filter("embedding_vector IS NOT NULL").select("pain_event_id", "embedding_vector")
    target = cut(rows)
    both = rows.agg(_n().alias("source")).crossJoin(target.agg(_n().alias("target")))  # one row each
    return both.withColumn("same", F.col("source") == F.col("target"))


@query("m12_status_update", "SELECT id, CASE WHEN cluster_name IN (SELECT min(cluster_name) FROM clusters WHERE trim(cluster_name) <> '') THEN 'processed' ELSE alignment_status END AS status FROM clusters", now=False)
def m12(t):
    """The status of the clusters of the least name set to processed; an update that matches no cluster raises."""
    update = t.clusters.filter("trim(cluster_name) <> ''").agg(F.min("cluster_name").alias("cluster_name")).withColumn("new", F.lit("processed"))
    return updated_status(t.clusters, update).select("id", F.col("alignment_status").alias("status"))


def updated_status(clusters, updates):
    """``clusters`` with the ``new`` status of ``updates`` (cluster_name, new; names unique); raises if a name matches no cluster."""
    missing = updates.join(clusters.select("cluster_name"), "cluster_name", "left_anti").head(1)
    if missing:
        raise ValueError(f"no cluster is named {missing[0]['cluster_name']}")
    return clusters.join(updates, "cluster_name", "left").withColumn("alignment_status", F.coalesce("new", "alignment_status")).drop("new")
