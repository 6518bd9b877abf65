"""Sources: JSON landing folders of forums, configuration fan-out, reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORUM = "id string, title string, selftext string, subreddit string, permalink string, score int, num_comments int, upvote_ratio double, created_utc double, author string, link_flair_text string"
STORY = "id long, type string, title string, text string, url string, `by` string, score int, descendants int, time long, kids array<long>"


def forum_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a landing folder of JSON lines, normalised to the columns of ``posts``.

    The schema is fixed, so nothing is inferred; unreadable lines come out as rows of nulls and are dropped with those
    that lack an id. A missing author becomes ``[deleted]``; other fields are kept as they come.
    """
    raw = spark.read.schema(FORUM).json(path).filter(F.col("id").isNotNull())
    author = F.when(F.trim(F.coalesce("author", F.lit(""))) == "", "[deleted]").otherwise(F.col("author"))
    return raw.select(
        F.concat(F.lit("reddit_"), "id").alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.col("selftext").alias("body"),
        "subreddit",
        F.lit("reddit").alias("source"),
        F.col("id").alias("source_id"),
        F.to_json(F.struct(F.col("link_flair_text").alias("flair"))).alias("platform_data"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        "upvote_ratio",
        "created_utc",
        F.timestamp_seconds("created_utc").alias("created_at"),
        author.alias("author"),
    )


def stories(spark: SparkSession, path: str) -> DataFrame:
    """Stories of a landing folder: kind ASK, SHOW or STORY by title; plain stories only with more than 10 comments."""
    raw = spark.read.schema(STORY).json(path).filter("id IS NOT NULL")
    title = F.lower(F.coalesce("title", F.lit("")))
    kind = F.when(title.startswith("ask hn"), "ASK").when(title.startswith("show hn"), "SHOW").otherwise("STORY")
    rows = raw.withColumn("kind", kind).filter((F.col("kind") != "STORY") | (F.coalesce("descendants", F.lit(0)) > 10))
    return rows.select(F.concat(F.lit("hackernews_"), F.col("id").cast("string")).alias("id"), "title", F.col("text").alias("body"), F.lit("hackernews").alias("source"), F.col("id").cast("string").alias("source_id"), "score", F.col("descendants").alias("num_comments"), F.col("by").alias("author"), "kind", "kids")


def comments_of(stories_: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, post_id, place, body): the first 10 child ids of each story with their bodies (id, body); a missing id falls back to the body's hash."""
    kids = stories_.select(F.col("id").alias("post_id"), F.posexplode(F.slice("kids", 1, 10)).alias("place", "kid"))
    got = kids.join(bodies.withColumnRenamed("id", "kid"), "kid", "left")
    return got.select(F.coalesce(F.col("kid").cast("string"), F.substring(F.md5("body"), 1, 12)).alias("id"), "post_id", "place", "body")


def fan_out(spark: SparkSession, config: dict) -> DataFrame:
    """(group, subreddit, settings): one row per subreddit of a nested configuration, without the groups ``ignore`` and ``search_strategy``; scalars are no subreddits."""
    import json

    rows = [(g, s, json.dumps(v, sort_keys=True)) for g, subs in config.items() if g not in ("ignore", "search_strategy") and isinstance(subs, dict) for s, v in subs.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "`group` string, subreddit string, settings string")


def read_config(path: str) -> dict:
    """A YAML file as nested dicts; an empty file gives an empty one."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stage metrics from JSON files that each hold one object or an array."""
    return spark.read.schema("stage string, started double, ended double, items long, tokens long").json(path, multiLine=True)
