"""The signal filter: an ordered chain of gates and a score, as one projection over posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import lexicons as L
from siftspark.functions import text as X


def with_signals(posts: DataFrame) -> DataFrame:
    """``posts`` with text, numbers of hits and scores of pain, aspiration, patterns and emotion; null texts count as empty."""
    df = posts.withColumn("text", X.whole_text())
    text = F.col("text")
    return df.withColumns(
        {
            "pain_hits": X.held_count(text, X.every_word(L.PAIN)),
            "aspiration_hits": X.held_count(text, X.every_word(L.ASPIRATION)),
            "patterns": X.held_count(text, L.PATTERNS),
            "keyword_score": X.lexicon_score(text, L.PAIN, L.PAIN_WEIGHTS, 5.0),
            "aspiration": X.lexicon_score(text, L.ASPIRATION, L.ASPIRATION_WEIGHTS, 3.0),
            "emotion": X.emotion(text),
        }
    )


def quality_reason(score="score", comments="num_comments", ratio="upvote_ratio"):
    """Why a post fails the quality gate, the first reason that applies; null if it passes. Null counts count as 0, a null ratio as 0."""
    n = F.length(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    return (
        F.when(F.coalesce(score, F.lit(0)) < 5, "few upvotes")
        .when(F.coalesce(comments, F.lit(0)) < 3, "few comments")
        .when(F.coalesce(ratio, F.lit(0.0)) < 0.1, "low ratio")
        .when(n < 50, "too short")
        .when(n > 5000, "too long")
    )


def exclusion(text):
    """The first (category, pattern) of the exclusion list in a text as ``category: pattern``; null if none."""
    pairs = [(f"{c}: {p}", p) for c, ps in L.EXCLUDE.items() for p in ps]
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), name) for name, p in pairs])


def composite(keyword, patterns, emotion, score, comments):
    """0.4 keywords, 0.3 patterns (full at 3), 0.2 emotion, 0.1 popularity, within 0 and 1."""
    popular = (F.least(F.coalesce(score, F.lit(0)) / 100, F.lit(1.0)) + F.least(F.coalesce(comments, F.lit(0)) / 50, F.lit(1.0))) / 2
    total = 0.4 * keyword + 0.3 * F.least(patterns / 3, F.lit(1.0)) + 0.2 * emotion + 0.1 * popular
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def post_type(subreddit="subreddit", score="score", comments="num_comments"):
    """The kind of a post by its subreddit, or ``discussion`` with more than two comments an upvote, else ``general``; nulls count as empty and 0."""
    name, n, up = F.lower(F.coalesce(subreddit, F.lit(""))), F.coalesce(comments, F.lit(0)), F.coalesce(score, F.lit(0))
    out = None
    for kind, words in L.POST_TYPES.items():
        held = name.rlike("|".join(words)) | (n > up * 2 if kind == "discussion" else F.lit(False))
        out = F.when(held, kind) if out is None else out.when(held, kind)
    return out.otherwise("general")


def type_reason(kind, score="score", comments="num_comments"):
    """Why a post fails the gate of its kind; null if it passes."""
    up, n = F.coalesce(score, F.lit(0)), F.coalesce(comments, F.lit(0))
    tests = []
    for k, (least_up, least_n) in L.POST_TYPE_LEAST.items():
        tests += [F.when((kind == k) & (up < least_up), f"{k}: few upvotes"), F.when((kind == k) & (n < least_n), f"{k}: few comments")]
    return F.coalesce(*tests)


def category_trust(category="category"):
    """The trust of a category; null for one without."""
    out = F.lit(None).cast("double")
    for name, value in L.CATEGORY_TRUST.items():
        out = F.when(F.col(category) == name, value).otherwise(out)
    return out


def trust_thresholds(trust):
    """struct(min_comments, min_upvotes, min_engagement) of a trust, the default one if null."""
    t, out = F.coalesce(trust, F.lit(L.TRUST_DEFAULT)), None
    for bound, (n, up, eng) in L.TRUST_TIERS:
        row = F.struct(F.lit(n).alias("min_comments"), F.lit(up).alias("min_upvotes"), F.lit(eng).alias("min_engagement"))
        if bound is None:
            return out.otherwise(row)
        out = F.when(t < bound, row) if out is None else out.when(t < bound, row)


def engagement(thresholds, score="score", comments="num_comments"):
    """Mean of upvotes and comments over their least values, at most 1."""
    both = F.coalesce(score, F.lit(0)) / thresholds["min_upvotes"] + F.coalesce(comments, F.lit(0)) / thresholds["min_comments"]
    return F.least(both / 2, F.lit(1.0))


def gated(posts: DataFrame) -> DataFrame:
    """``posts`` with every gate and score of the filter: quality, excluded, kind, type_reason, least (thresholds), engagement, low_trust, pain, path.

    Trust is the row's, else that of its category, else 0.5; only a row's own trust below 0.5 makes engagement a gate. ``path`` is ``pain`` with at
    least one keyword, emotion from 0.3 and pain score from 0.3, else ``aspiration`` with enough engagement and an aspiration score from 0.4.
    """
    df = with_signals(posts).withColumn("quality", quality_reason()).withColumn("excluded", exclusion(F.col("text"))).withColumn("kind", post_type())
    df = df.withColumn("type_reason", type_reason(F.col("kind"))).withColumn("least", trust_thresholds(F.coalesce("trust_level", category_trust())))
    df = df.withColumn("engagement", engagement(F.col("least")))
    low = (F.coalesce("trust_level", F.lit(L.TRUST_DEFAULT)) < 0.5) & (F.col("engagement") < F.col("least.min_engagement"))
    df = df.withColumn("low_trust", F.when(low, "low trust: little engagement"))
    df = df.withColumn("pain", composite(F.col("keyword_score"), F.col("patterns"), F.col("emotion"), F.col("score"), F.col("num_comments")))
    path = F.when((F.col("pain_hits") >= 1) & (F.col("emotion") >= 0.3) & (F.col("pain") >= 0.3), "pain")
    path = path.when((F.col("aspiration_hits") >= 1) & (F.col("engagement") >= F.col("least.min_engagement")) & (F.col("aspiration") >= 0.4), "aspiration")
    return df.withColumn("path", path)


def failure_codes():
    """The codes of what a post on neither path lacks, joined; empty if nothing of the first path."""
    tests = [F.col("pain_hits") < 1, F.col("emotion") < 0.3, F.col("pain") < 0.3]
    return F.concat_ws("; ", *[F.when(t, code) for t, code in zip(tests, L.FAILURES)])


def signal_filter(posts: DataFrame) -> DataFrame:
    """(id, reason, pass_type, pain_score, aspiration_score, engagement_score) of every post: the first failing gate (quality, exclusion, kind,
    low trust) or what it lacks on both paths, or the path on which it passes. The aspiration score counts on the second path only."""
    df = gated(posts).withColumn("gate", F.coalesce("quality", "excluded", "type_reason", "low_trust"))
    passed = F.when(F.col("gate").isNull(), F.col("path"))
    return df.select(
        "id",
        F.coalesce("gate", F.when(F.col("path").isNull(), F.concat(F.lit("failed: "), failure_codes()))).alias("reason"),
        passed.alias("pass_type"),
        F.round("pain", 6).alias("pain_score"),
        F.round(F.when(passed == "aspiration", F.col("aspiration")).otherwise(0.0), 6).alias("aspiration_score"),
        F.round("engagement", 6).alias("engagement_score"),
    )
