"""Scalar functions and expression idioms."""

from pyspark.sql import functions as F

from siftspark.catalog.aggregates import _freq_sql
from siftspark.catalog.base import query, values
from siftspark.functions import lexicons as L
from siftspark.functions import text as X

_EVENT_TEXT = "lower(coalesce(problem, '')) || ' ' || lower(coalesce(context, ''))"


@query("x01_substring_containment", f"SELECT id, count(*) AS hits FROM events_now JOIN {values([(k,) for ks in L.PAIN.values() for k in ks], 'k(kw)')} ON contains(lower(problem), k.kw) GROUP BY 1")
def x01(t):
    hits = X.held_count(F.lower("problem"), X.every_word(L.PAIN))
    return t.events("problem").filter("problem IS NOT NULL").select("id", hits.cast("long").alias("hits")).filter("hits > 0")


@query("x02_embedding_text", "SELECT id, concat_ws(' | ', nullif(problem, ''), nullif(context, ''), nullif(frequency, '')) AS text FROM events_now")
def x02(t):
    return t.events("problem", "context", "frequency").select("id", X.joined(" | ", "problem", "context", "frequency").alias("text"))


@query("x04_prefix", "SELECT id, substr(problem, 1, 40) AS prefix FROM events_now")
def x04(t):
    return t.events("problem").select("id", F.substring("problem", 1, 40).alias("prefix"))


_TYPES = values([(i, c, k) for i, (c, ks) in enumerate(L.PAIN_TYPES.items()) for k in ks], "k(i, cat, kw)")


@query("x05_pain_type", f"SELECT e.id, coalesce(arg_min(k.cat, k.i), 'general') AS kind, count(DISTINCT k.cat) AS kinds FROM (SELECT id, {_EVENT_TEXT} AS text FROM events_now) e LEFT JOIN {_TYPES} ON contains(e.text, k.kw) GROUP BY 1")
def x05(t):
    text = F.concat_ws(" ", F.lower(F.coalesce("problem", F.lit(""))), F.lower(F.coalesce("context", F.lit(""))))
    e = t.events("problem", "context").select("id", X.labels(text, L.PAIN_TYPES).alias("k"))
    return e.select("id", F.coalesce(F.try_element_at("k", F.lit(1)), F.lit("general")).alias("kind"), F.size("k").cast("long").alias("kinds"))


@query("x06_tool_extractor", f"SELECT e.id, string_agg(DISTINCT k.kw, ',' ORDER BY k.kw) AS tools FROM (SELECT id, {_EVENT_TEXT} AS text FROM events_now) e JOIN {values([(k,) for k in L.TOOLS], 'k(kw)')} ON contains(e.text, k.kw) GROUP BY 1")
def x06(t):
    text = F.concat_ws(" ", F.lower(F.coalesce("problem", F.lit(""))), F.lower(F.coalesce("context", F.lit(""))))
    e = t.events("problem", "context").select("id", F.sort_array(X.held(text, L.TOOLS)).alias("k")).filter(F.size("k") > 0)
    return e.select("id", F.array_join("k", ",").alias("tools"))


@query("x07_frequency_score", f"SELECT id, {_freq_sql('frequency')} AS score FROM events_now")
def x07(t):
    return t.events("frequency").select("id", X.first_score(F.col("frequency"), L.FREQUENCY, L.FREQUENCY_DEFAULT).alias("score"))


_COARSE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(frequency), '{k}')" for k in ks) + f" THEN {v}" for ks, v in L.FREQUENCY_COARSE) + f" ELSE {L.FREQUENCY_COARSE_DEFAULT} END"


@query("x08_coarse_frequency", f"SELECT id, {_COARSE} AS score FROM events_now")
def x08(t):
    return t.events("frequency").select("id", X.coarse_frequency(F.col("frequency")).alias("score"))


@query("x19_log_scale", "SELECT id, round(log10(greatest(coalesce(cluster_size, 0), 1)) * 2.5, 6) AS s FROM clusters", now=False)
def x19(t):
    return t.clusters.select("id", F.round(F.log10(F.greatest(F.coalesce("cluster_size", F.lit(0)), F.lit(1))) * 2.5, 6).alias("s"))


@query("x24_json_parse", "SELECT id, json_extract_string(platform_data, '$.flair') AS flair FROM posts_now WHERE json_valid(platform_data)")
def x24(t):
    return t.posts("platform_data").filter(F.try_parse_json("platform_data").isNotNull()).select("id", F.get_json_object("platform_data", "$.flair").alias("flair"))


@query("x26_null_defaults", "SELECT id, coalesce(source, 'reddit') AS source, coalesce(score, 0) AS score, coalesce(trust_level, 0.5) AS trust FROM posts_now")
def x26(t):
    return t.posts("source", "score", "trust_level").select("id", F.coalesce("source", F.lit("reddit")).alias("source"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("trust_level", F.lit(0.5)).alias("trust"))


@query("x27_case_round_concat", "SELECT id, CASE WHEN pain_score >= 0.5 THEN 'high' ELSE 'low' END || ':' || CAST(length(title) AS VARCHAR) AS tag, round(pain_score * 100, 1) AS pct FROM filtered_now WHERE title IS NOT NULL")
def x27(t):
    tag = F.concat(F.when(F.col("pain_score") >= 0.5, "high").otherwise("low"), F.lit(":"), F.length("title").cast("string"))
    return t.filtered("pain_score", "title").filter("title IS NOT NULL").select("id", tag.alias("tag"), F.round(F.col("pain_score") * 100, 1).alias("pct"))


@query("x28_day_difference", "SELECT id, CAST(floor(date_diff('second', created_at, collected_at) / 86400) AS BIGINT) AS days FROM posts_now WHERE created_at IS NOT NULL AND collected_at IS NOT NULL")
def x28(t):
    seconds = F.expr("timestampdiff(SECOND, created_at, collected_at)")
    return t.posts("created_at").filter("created_at IS NOT NULL AND collected_at IS NOT NULL").select("id", F.floor(seconds / 86400).cast("long").alias("days"))


@query("x29_regex_flags", "SELECT id, regexp_matches(lower(problem), 'hour|week|month') AS timed, len(regexp_extract_all(problem, '[0-9]+')) AS numbers FROM events_now WHERE problem IS NOT NULL")
def x29(t):
    return t.events("problem").filter("problem IS NOT NULL").select("id", F.lower("problem").rlike("hour|week|month").alias("timed"), F.regexp_count("problem", F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("x30_md5_fallback_id", "SELECT id, coalesce(source, 'x') || '_' || substr(md5(title), 1, 12) AS fallback FROM posts_now WHERE title IS NOT NULL")
def x30(t):
    return t.posts("title", "source").filter("title IS NOT NULL").select("id", F.concat(F.coalesce("source", F.lit("x")), F.lit("_"), F.substring(F.md5("title"), 1, 12)).alias("fallback"))


@query("x34_safe_ratio", "SELECT id, round(num_comments / greatest(score, 1), 6) AS ratio FROM posts_now WHERE num_comments IS NOT NULL AND score IS NOT NULL")
def x34(t):
    return t.posts("num_comments", "score").filter("num_comments IS NOT NULL AND score IS NOT NULL").select("id", F.round(F.col("num_comments") / F.greatest("score", F.lit(1)), 6).alias("ratio"))


@query("x37_fallback_summary", "SELECT cluster_id, 'Cluster with ' || CAST(count(*) AS VARCHAR) || ' pain events' AS title, string_agg(CASE WHEN r <= 5 THEN problem END, ' | ' ORDER BY id) AS summary FROM (SELECT cluster_id, id, problem, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS r FROM events_now WHERE cluster_id IS NOT NULL AND coalesce(problem, '') <> '') GROUP BY 1")
def x37(t):
    from pyspark.sql import Window

    e = t.events("cluster_id", "problem").filter("cluster_id IS NOT NULL AND coalesce(problem, '') <> ''")
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")))
    first = F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "problem"))))
    g = e.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(first, lambda x: x["problem"]), " | ").alias("summary"))
    return g.select("cluster_id", F.concat(F.lit("Cluster with "), F.col("n").cast("string"), F.lit(" pain events")).alias("title"), "summary")


@query("x09_market_size", "SELECT e.cluster_id, round(least(least(count(DISTINCT f.author) / 10.0, 5) + least(1.5 * count(DISTINCT f.subreddit), 5), 10) + 1e-9, 6) AS score FROM events_now e JOIN filtered_now f ON f.id = e.post_id WHERE e.cluster_id IS NOT NULL GROUP BY 1")
def x09(t):
    f = t.filtered("author", "subreddit").select(F.col("id").alias("post_id"), "author", "subreddit")
    e = t.events("cluster_id", "post_id").filter("cluster_id IS NOT NULL").join(f, "post_id")
    size = F.least(F.countDistinct("author") / 10, F.lit(5.0)) + F.least(1.5 * F.countDistinct("subreddit"), F.lit(5.0))
    return e.groupBy("cluster_id").agg(F.round(F.least(size, F.lit(10.0)) + 1e-9, 6).alias("score"))
