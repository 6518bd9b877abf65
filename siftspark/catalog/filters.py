"""Text predicates, lexicon scores and validators."""

from pyspark.sql import functions as F

from siftspark.catalog.base import query, values
from siftspark.functions import lexicons as L
from siftspark.functions import text as X
from siftspark.operators import signal

_TEXT = "lower(coalesce(title, '')) || ' ' || lower(coalesce(body, ''))"
_LEN = "length(coalesce(title, '') || ' ' || coalesce(body, ''))"
_POSTS = ("title", "body", "subreddit", "score", "num_comments", "upvote_ratio", "trust_level", "category")


def _words(lexicon, weights):
    return values([(c, k, weights.get(c, L.OTHER_WEIGHT)) for c, ks in lexicon.items() for k in ks], "k(cat, kw, w)")


def _score_sql(lexicon, weights, full):
    return f"(SELECT t.id, coalesce(count(k.kw), 0) AS hits, least(coalesce(sum(2 * CAST(k.w AS DOUBLE)), 0) / {full}, 1.0) AS s FROM t LEFT JOIN {_words(lexicon, weights)} ON contains(t.text, k.kw) GROUP BY t.id)"


_EMO = values([(w, k) for k, ws in L.EMOTION.items() for w in ws], "e(kw, w)")
_T = f"t AS (SELECT *, {_TEXT} AS text, {_LEN} AS n FROM posts_now)"
_QUALITY = "CASE WHEN coalesce(score, 0) < 5 THEN 'few upvotes' WHEN coalesce(num_comments, 0) < 3 THEN 'few comments' WHEN coalesce(upvote_ratio, 0) < 0.1 THEN 'low ratio' WHEN n < 50 THEN 'too short' WHEN n > 5000 THEN 'too long' END"
_EXCLUDED = f"(SELECT t.id, arg_min(x.name, x.i) AS excluded FROM t JOIN {values([(i, f'{c}: {p}', p) for i, (c, p) in enumerate((c, p) for c, ps in L.EXCLUDE.items() for p in ps)], 'x(i, name, p)')} ON contains(t.text, x.p) GROUP BY t.id)"
_EMOTION = f"(SELECT t.id, least(coalesce(sum(CAST(e.w AS DOUBLE)), 0) / greatest(max(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda v: v <> ''))) / 100.0, 1.0), 1.0) AS emo FROM t LEFT JOIN {_EMO} ON contains(t.text, e.kw) GROUP BY t.id)"
_PATTERN = f"(SELECT t.id, count(x.p) AS pats FROM t LEFT JOIN {values([(p,) for p in L.PATTERNS], 'x(p)')} ON contains(t.text, x.p) GROUP BY t.id)"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(subreddit, '')), '{'|'.join(ws)}')" + (" OR coalesce(num_comments, 0) > coalesce(score, 0) * 2" if k == "discussion" else "") + f" THEN '{k}'" for k, ws in L.POST_TYPES.items()) + " ELSE 'general' END"
_TYPE_REASON = "CASE " + " ".join(f"WHEN {_TYPE} = '{k}' AND coalesce({c}, 0) < {n} THEN '{k}: few {w}'" for k, least in L.POST_TYPE_LEAST.items() for c, w, n in zip(("score", "num_comments"), ("upvotes", "comments"), least)) + " END"
_TRUST = "coalesce(trust_level, CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.CATEGORY_TRUST.items()) + f" END, {L.TRUST_DEFAULT})"
_TIER = "CASE " + " ".join(f"WHEN {_TRUST} < {b} THEN [{n}, {up}, {e}]" if b else f"ELSE [{n}, {up}, {e}]" for b, (n, up, e) in L.TRUST_TIERS) + " END"
_ENGAGEMENT = f"least((coalesce(score, 0) / CAST(({_TIER})[2] AS DOUBLE) + coalesce(num_comments, 0) / CAST(({_TIER})[1] AS DOUBLE)) / 2, 1.0)"
_ALL = f"""WITH {_T}, kw AS {_score_sql(L.PAIN, L.PAIN_WEIGHTS, 5.0)}, asp AS {_score_sql(L.ASPIRATION, L.ASPIRATION_WEIGHTS, 3.0)}, emo AS {_EMOTION}, pat AS {_PATTERN}, exc AS {_EXCLUDED},
m AS (SELECT t.id, {_QUALITY} AS quality, {_TYPE_REASON} AS type_reason, {_TIER} AS least, coalesce(trust_level, 0.5) < 0.5 AS low, {_ENGAGEMENT} AS eng, exc.excluded, kw.hits AS kh, kw.s AS ks, asp.hits AS ah, asp.s AS asps, emo, pats,
  greatest(least(0.4 * kw.s + 0.3 * least(pats / 3.0, 1.0) + 0.2 * emo + 0.1 * (least(coalesce(score, 0) / 100.0, 1.0) + least(coalesce(num_comments, 0) / 50.0, 1.0)) / 2, 1.0), 0.0) AS pain
  FROM t JOIN kw USING (id) JOIN asp USING (id) JOIN emo USING (id) JOIN pat USING (id) LEFT JOIN exc USING (id))"""


@query("f01_quality_gate", f"WITH {_T} SELECT id, {_QUALITY} AS reason FROM t")
def f01(t):
    return t.posts(*_POSTS).select("id", signal.quality_reason().alias("reason"))


@query("f02_keyword_match", f"WITH {_T}, kw AS {_score_sql(L.PAIN, L.PAIN_WEIGHTS, 5.0)} SELECT id, hits, round(s, 6) AS score FROM kw")
def f02(t):
    df = signal.with_signals(t.posts("title", "body"))
    return df.select("id", F.col("pain_hits").cast("long").alias("hits"), F.round("keyword_score", 6).alias("score"))


@query("f03_aspiration_match", f"WITH {_T}, kw AS {_score_sql(L.ASPIRATION, L.ASPIRATION_WEIGHTS, 3.0)} SELECT id, hits, round(s, 6) AS score FROM kw")
def f03(t):
    df = signal.with_signals(t.posts("title", "body"))
    return df.select("id", F.col("aspiration_hits").cast("long").alias("hits"), F.round("aspiration", 6).alias("score"))


@query("f04_pattern_match", f"WITH {_T} SELECT id, pats AS patterns FROM {_PATTERN}")
def f04(t):
    df = t.posts("title", "body").select("id", X.whole_text().alias("text"))
    return df.select("id", X.held_count(F.col("text"), L.PATTERNS).cast("long").alias("patterns"))


@query("f05_exclusion_gate", f"WITH {_T} SELECT id, excluded FROM {_EXCLUDED}")
def f05(t):
    df = t.posts("title", "body").select("id", X.whole_text().alias("text"))
    return df.select("id", signal.exclusion(F.col("text")).alias("excluded")).filter("excluded IS NOT NULL")


@query("f06_emotion_intensity", f"WITH {_T} SELECT id, round(emo, 6) AS emotion FROM {_EMOTION}")
def f06(t):
    df = t.posts("title", "body").select("id", X.whole_text().alias("text"))
    return df.select("id", F.round(X.emotion(F.col("text")), 6).alias("emotion"))


@query("f10_composite_score", f"{_ALL} SELECT id, round(pain, 6) AS pain_score FROM m")
def f10(t):
    df = signal.with_signals(t.posts(*_POSTS))
    return df.select("id", F.round(signal.composite(F.col("keyword_score"), F.col("patterns"), F.col("emotion"), F.col("score"), F.col("num_comments")), 6).alias("pain_score"))


_GATE = "coalesce(quality, excluded, type_reason, CASE WHEN low AND eng < least[3] THEN 'low trust: little engagement' END)"
_LACKS = f"concat_ws('; ', CASE WHEN kh < 1 THEN '{L.FAILURES[0]}' END, CASE WHEN emo < 0.3 THEN '{L.FAILURES[1]}' END, CASE WHEN pain < 0.3 THEN '{L.FAILURES[2]}' END)"
_DECIDED = f"""{_ALL}, d AS (SELECT *, {_GATE} AS why, {_LACKS} AS lacks, CASE WHEN kh >= 1 AND emo >= 0.3 AND pain >= 0.3 THEN 'pain' WHEN ah >= 1 AND eng >= least[3] AND asps >= 0.4 THEN 'aspiration' END AS path FROM m),
f AS (SELECT id, coalesce(why, CASE WHEN path IS NULL THEN 'failed: ' || lacks END) AS reason, CASE WHEN why IS NULL THEN path END AS pass_type, round(pain, 6) AS pain_score, round(CASE WHEN why IS NULL AND path = 'aspiration' THEN asps ELSE 0.0 END, 6) AS aspiration_score, round(eng, 6) AS engagement_score FROM d)"""


@query("f07_post_type_gate", f"SELECT id, {_TYPE} AS kind, {_TYPE_REASON} AS reason FROM posts_now")
def f07(t):
    """The kind of every post and why it fails that kind's gate."""
    return t.posts("subreddit", "score", "num_comments").select("id", signal.post_type().alias("kind"), signal.type_reason(signal.post_type()).alias("reason"))


@query("f08_trust_thresholds", f"SELECT id, CAST(({_TIER})[1] AS INT) AS min_comments, CAST(({_TIER})[2] AS INT) AS min_upvotes, CAST(({_TIER})[3] AS DOUBLE) AS min_engagement FROM posts_now")
def f08(t):
    """The thresholds of every post by its own trust, else its category's."""
    least = signal.trust_thresholds(F.coalesce("trust_level", signal.category_trust()))
    return t.posts("trust_level", "category").select("id", least.alias("l")).select("id", "l.*")


@query("f09_engagement_gate", f"SELECT id, round({_ENGAGEMENT}, 6) AS engagement, coalesce(trust_level, 0.5) < 0.5 AND {_ENGAGEMENT} < ({_TIER})[3] AS rejected FROM posts_now")
def f09(t):
    """The engagement of every post, and whether low trust rejects it."""
    df = t.posts("score", "num_comments", "trust_level", "category").withColumn("l", signal.trust_thresholds(F.coalesce("trust_level", signal.category_trust())))
    e = signal.engagement(F.col("l"))
    return df.select("id", F.round(e, 6).alias("engagement"), ((F.coalesce("trust_level", F.lit(0.5)) < 0.5) & (e < F.col("l.min_engagement"))).alias("rejected"))


@query("f11_signal_filter", f"{_DECIDED} SELECT * FROM f")
def f11(t):
    return signal.signal_filter(t.posts(*_POSTS))


@query("f12_failure_codes", f"{_DECIDED} SELECT id, lacks AS codes FROM d WHERE why IS NULL AND path IS NULL")
def f12(t):
    """What every post that passes the gates lacks where it passes on neither path."""
    df = signal.gated(t.posts(*_POSTS)).filter("coalesce(quality, excluded, type_reason, low_trust) IS NULL AND path IS NULL")
    return df.select("id", signal.failure_codes().alias("codes"))


@query("f13_filter_stats", f"{_DECIDED}, h AS (SELECT coalesce(reason, 'passed: ' || pass_type) AS outcome, count(*) AS n, count(pass_type) AS passed FROM f GROUP BY 1) SELECT outcome, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(sum(passed) OVER () AS BIGINT) AS passed, round(sum(passed) OVER () / greatest(sum(n) OVER (), 1), 6) AS pass_rate FROM h")
def f13(t):
    """Posts by outcome, with the total, the passed ones and their rate."""
    from pyspark.sql import Window

    df = signal.signal_filter(t.posts(*_POSTS))
    h = df.groupBy(F.coalesce("reason", F.concat(F.lit("passed: "), F.col("pass_type"))).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count("pass_type").alias("p"))
    # the window runs over the few outcomes only
    every = Window.partitionBy(F.lit(1))
    total, passed = F.sum("n").over(every), F.sum("p").over(every)
    return h.select("outcome", "n", total.alias("total"), passed.alias("passed"), F.round(passed / F.greatest(total, F.lit(1)), 6).alias("pass_rate"))


@query("f14_min_score", "SELECT id, pain_score FROM filtered_now WHERE pain_score >= 0.5")
def f14(t):
    return t.filtered("pain_score").filter("pain_score >= 0.5").select("id", "pain_score")


_QUICK = f"(SELECT t.id, count(x.p) AS quick FROM t LEFT JOIN {values([(p,) for p in L.QUICK_EMOTION], 'x(p)')} ON contains(t.text, x.p) GROUP BY t.id)"


@query("f15_pre_score", f"WITH {_T}, kw AS {_score_sql(L.PAIN, L.PAIN_WEIGHTS, 5.0)}, q AS {_QUICK} SELECT id, round(least(CASE WHEN coalesce(score, 0) >= 5 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(num_comments, 0) >= 3 THEN 0.2 ELSE 0 END + 0.1 * hits + CASE WHEN length(text) > 200 THEN 0.1 ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.1 ELSE 0 END + 0.05 * quick, 1.0), 6) AS score FROM t JOIN kw USING (id) JOIN q USING (id)")
def f15(t):
    df = t.posts(*_POSTS).withColumn("text", X.whole_text())
    hits = X.held_count(F.col("text"), X.every_word(L.PAIN))
    bonus = lambda c, v: F.when(c, v).otherwise(0.0)
    total = bonus(F.coalesce("score", F.lit(0)) >= 5, 0.3) + bonus(F.coalesce("num_comments", F.lit(0)) >= 3, 0.2) + 0.1 * hits
    total = total + bonus(F.length("text") > 200, 0.1) + bonus(F.length("text") > 500, 0.1) + 0.05 * X.held_count(F.col("text"), L.QUICK_EMOTION)
    return df.select("id", F.round(F.least(total, F.lit(1.0)), 6).alias("score"))


@query("f16_simple_pain", f"WITH {_T}, kw AS {_score_sql(L.PAIN, L.PAIN_WEIGHTS, 5.0)} SELECT id FROM t JOIN kw USING (id) WHERE score >= 5 AND num_comments >= 3 AND hits >= 1")
def f16(t):
    df = t.posts(*_POSTS).filter("score >= 5 AND num_comments >= 3").withColumn("text", X.whole_text())
    return df.filter(X.held_count(F.col("text"), X.every_word(L.PAIN)) >= 1).select("id")


@query("f18_event_validator", f"SELECT id FROM events_now WHERE coalesce(problem, '') <> '' AND coalesce(post_id, '') <> '' AND length(problem) BETWEEN 10 AND 1000 AND extraction_confidence >= 0.3 AND lower(problem) NOT IN ({', '.join(chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in L.GENERIC_PROBLEMS)})")
def f18(t):
    df = t.events("problem", "post_id", "extraction_confidence")
    good = (F.col("post_id") != "") & F.length("problem").between(10, 1000) & (F.col("extraction_confidence") >= 0.3)
    return df.filter(good & ~F.lower("problem").isin(L.GENERIC_PROBLEMS)).select("id")


@query("f19_opportunity_validator", "SELECT id, CASE WHEN coalesce(opportunity_name, '') = '' OR coalesce(description, '') = '' OR coalesce(target_users, '') = '' THEN 'missing' WHEN length(opportunity_name) < 3 THEN 'short name' WHEN length(description) < 20 THEN 'short description' WHEN length(target_users) < 10 THEN 'short target' END AS reason FROM opportunities")
def f19(t):
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    reason = F.when(empty("opportunity_name") | empty("description") | empty("target_users"), "missing").when(F.length("opportunity_name") < 3, "short name")
    reason = reason.when(F.length("description") < 20, "short description").when(F.length("target_users") < 10, "short target")
    return t.opportunities.select("id", reason.alias("reason"))


@query("f20_embedding_validator", "SELECT pain_event_id, CASE WHEN embedding_vector IS NULL THEN 'missing' WHEN len(embedding_vector) = 0 THEN 'empty' WHEN len(list_filter(embedding_vector, lambda v: v IS NULL OR isnan(v))) > 0 THEN 'not a number' WHEN len(list_filter(embedding_vector, lambda v: abs(v) >= 1e-6)) = 0 THEN 'all zero' END AS reason FROM emb_now")
def f20(t):
    v = F.col("embedding_vector")
    reason = F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "not a number")
    reason = reason.when(F.forall(v, lambda x: F.abs(x) < 1e-6), "all zero")
    return t.embeddings("embedding_vector").select("pain_event_id", reason.alias("reason"))


@query("f22_hard_filter", "SELECT o.id FROM opportunities o JOIN clusters c ON c.id = o.cluster_id WHERE o.raw_total_score >= 6.0 AND c.cluster_size >= 4 AND o.trust_level >= 0.5 AND NOT EXISTS (SELECT 1 FROM (VALUES ('cluster_1'), ('cluster_2')) x(n) WHERE x.n = c.cluster_name)", now=False)
def f22(t):
    ignored = t.spark.createDataFrame([("cluster_1",), ("cluster_2",)], "cluster_name string")
    kept = t.clusters.filter("cluster_size >= 4").join(ignored, "cluster_name", "left_anti").select(F.col("id").alias("cluster_id"))
    return t.opportunities.filter("raw_total_score >= 6.0 AND trust_level >= 0.5").join(kept, "cluster_id").select("id")


@query("f23_status_or_null", "SELECT id FROM clusters WHERE alignment_status IN ('unprocessed', 'processed') OR alignment_status IS NULL", now=False)
def f23(t):
    s = F.col("alignment_status")
    return t.clusters.filter(s.isin("unprocessed", "processed") | s.isNull()).select("id")


@query("f24_threshold_query", "SELECT id, product_impact FROM clusters WHERE product_impact >= 0.5 AND semantic_category = 'automation'", now=False)
def f24(t):
    return t.clusters.filter("product_impact >= 0.5 AND semantic_category = 'automation'").select("id", "product_impact").orderBy(F.desc("product_impact"), "id")


@query("f25_relative_time", "SELECT id FROM events_now WHERE extracted_at > TIMESTAMP '2024-04-01 00:00:00' - INTERVAL 7 DAY AND extracted_at <= TIMESTAMP '2024-04-01 00:00:00'")
def f25(t):
    return t.events().filter("extracted_at > TIMESTAMP_NTZ '2024-04-01 00:00:00' - INTERVAL 7 DAY AND extracted_at <= TIMESTAMP_NTZ '2024-04-01 00:00:00'").select("id")


@query("f26_zero_or_null", "SELECT id FROM opportunities WHERE total_score = 0 OR total_score IS NULL", now=False)
def f26(t):
    return t.opportunities.filter(F.coalesce("total_score", F.lit(0)) == 0).select("id")


@query("f28_missing_semantics", "SELECT id FROM clusters WHERE trim(coalesce(centroid_summary, '')) = '' OR trim(coalesce(cluster_name, '')) = ''", now=False)
def f28(t):
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return t.clusters.filter(blank("centroid_summary") | blank("cluster_name")).select("id")


@query("f17_category_lookup", f"SELECT category, count(*) AS n, max({_TRUST.replace('trust_level, ', '')}) AS trust FROM posts_now GROUP BY 1")
def f17(t):
    """The trust of every category: its own, else the default; subreddits without a row of their own take their category's."""
    g = t.posts("category").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return g.select("category", "n", F.coalesce(signal.category_trust(), F.lit(L.TRUST_DEFAULT)).alias("trust"))


@query("f21_cluster_gate", f"""WITH g AS (SELECT c.id, count(e.id) AS size, count(DISTINCT f.author) AS authors, count(DISTINCT f.subreddit) AS subs, coalesce(avg(CASE WHEN e.id IS NOT NULL THEN CASE {' '.join(f"WHEN contains(lower(e.frequency), '{k}') THEN {v}" for k, v in L.FREQUENCY.items())} ELSE {L.FREQUENCY_DEFAULT} END END), 0) AS freq
  FROM clusters c LEFT JOIN events_now e ON e.cluster_id = c.id LEFT JOIN filtered_now f ON f.id = e.post_id GROUP BY 1)
SELECT id, CASE WHEN size < 5 THEN 'size ' || size || ' < 5' WHEN authors < 4 THEN 'authors ' || authors || ' < 4' WHEN subs < 1 THEN 'subreddits ' || subs || ' < 1' WHEN round(freq, 6) < 5.0 THEN 'frequency ' || printf('%.1f', round(freq + 1e-9, 1)) || ' < 5.0' END AS reason FROM g""")
def f21(t):
    """Why every cluster is skipped, the first reason of size, authors, subreddits and mean frequency; null if it is worked on."""
    from siftspark.catalog.aggregates import cluster_metrics

    m, least = cluster_metrics(t), L.CLUSTER_LEAST
    freq = F.coalesce("frequency", F.lit(0.0))
    short = lambda c, what, n: F.when(F.col(c) < n, F.format_string(f"{what} %d < {n}", F.col(c)))
    reason = F.coalesce(short("size", "size", least["size"]), short("authors", "authors", least["authors"]), short("subreddits", "subreddits", least["subreddits"]), F.when(F.round(freq, 6) < least["frequency"], F.format_string("frequency %.1f < 5.0", F.round(freq, 1))))
    return m.select("id", reason.alias("reason"))


@query("f27_comment_thresholds", f"{_ALL.replace('posts_now)', 'posts_now WHERE coalesce(score, 0) >= 10 AND length(body) >= 30)')} SELECT id FROM m WHERE round(pain, 9) >= 0.3 AND kh >= 2 AND round(emo, 9) >= 0.2 AND eng >= 0.1")
def f27(t):
    """Texts that reach every threshold of a comment: score, length, pain, keywords, emotion and engagement. Posts stand for comments, of which the tables have none."""
    least = L.COMMENT_LEAST
    df = signal.gated(t.posts(*_POSTS).filter((F.coalesce("score", F.lit(0)) >= least["score"]) & (F.length("body") >= least["length"])))
    return df.filter((F.round("pain", 9) >= least["pain"]) & (F.col("pain_hits") >= least["keywords"]) & (F.round("emotion", 9) >= least["emotion"]) & (F.col("engagement") >= least["engagement"])).select("id")
