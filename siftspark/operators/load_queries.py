"""Queries of problem 7: per-subreddit results without imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.names import subreddit_name
from siftspark.operators.current import current_rows
from siftspark.operators.skew import join_by_load, top_per_key
from siftspark.sources.tables import table


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("subreddit", subreddit_name(F.col("subreddit"))).filter(F.col("subreddit") != "")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """(subreddit, post_id): the 10 posts of each subreddit with most comments, then highest score, then smaller id."""
    posts = _named(current_rows(table(spark, folder, "posts"), "id", "collected_at", ["subreddit", "num_comments", "score"]))
    order = [F.desc(F.coalesce("num_comments", F.lit(-1))), F.desc_nulls_last("score"), F.asc("id")]
    return top_per_key(posts, "subreddit", order, 10, "id").select("subreddit", F.col("id").alias("post_id"))


def p7_kept_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(subreddit, posts, kept, pain): per subreddit of posts the posts, those also in filtered_posts under that name, and their mean pain_score to 4 digits."""
    posts = _named(current_rows(table(spark, folder, "posts"), "id", "collected_at", ["subreddit"]))
    kept = _named(current_rows(table(spark, folder, "filtered_posts"), "id", "filtered_at", ["subreddit", "pain_score"]))
    kept = kept.groupBy("subreddit").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("pain_score") + 1e-9, 4).alias("pain"))
    joined = join_by_load(posts.select("id", "subreddit"), kept, "subreddit", "id", "left")
    return joined.groupBy("subreddit").agg(F.count(F.lit(1)).alias("posts"), F.coalesce(F.max("kept"), F.lit(0).cast("long")).alias("kept"), F.max("pain").alias("pain"))


_EDGES = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"


def _name_sql(column: str) -> str:
    trim = lambda x: f"regexp_replace({x}, {_EDGES}, '', 'g')"
    return trim(f"regexp_replace(lower({trim(column)}), '^/?r/', '')")


_POSTS = f"""
posts_now AS (SELECT id, {_name_sql('subreddit')} AS subreddit, num_comments, score FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY collected_at DESC) AS rn FROM posts WHERE id IS NOT NULL) WHERE rn = 1)"""

SQL = {
    "p7_found": f"""
WITH {_POSTS}
SELECT subreddit, id AS post_id FROM (
  SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY coalesce(num_comments, -1) DESC, score DESC NULLS LAST, id) AS r
  FROM posts_now WHERE subreddit <> '') WHERE r <= 10""",
    "p7_kept_shares": f"""
WITH {_POSTS},
kept AS (SELECT {_name_sql('subreddit')} AS subreddit, pain_score FROM
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY filtered_at DESC) AS rn FROM filtered_posts WHERE id IS NOT NULL) WHERE rn = 1),
agg AS (SELECT subreddit, count(*) AS kept, round(avg(pain_score) + 1e-9, 4) AS pain FROM kept WHERE subreddit <> '' GROUP BY 1)
SELECT p.subreddit, count(*) AS posts, coalesce(max(a.kept), 0) AS kept, max(a.pain) AS pain
FROM posts_now p LEFT JOIN agg a ON a.subreddit = p.subreddit WHERE p.subreddit <> '' GROUP BY 1""",
}


def queries() -> dict:
    return {"p7_found": p7_found, "p7_kept_shares": p7_kept_shares}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
