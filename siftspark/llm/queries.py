"""The pN_ queries: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import bpe, capping, cutoffs, density, leaks, neardup, pii, subjects, vectors
from siftspark.functions.names import author_name, source_name, subreddit_name
from siftspark.operators.current import current_rows, current_wide_rows
from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut
from siftspark.sources.tables import table

DIM = 64  #: numbers of an embedding
LINK = 0.85  #: cosine from which events are linked
NEAREST = 5  #: neighbours of an event


def _routed(spark: SparkSession, folder: str) -> vectors.Routed:
    rows = table(spark, folder, "pain_embeddings")
    usable = vectors.usable_vectors(rows, "pain_event_id", "embedding_vector", "created_at", DIM)
    n = rows.count()
    return vectors.route(usable, DIM, n, sample=vectors.packed(vectors.sampled(rows, "pain_event_id", n), "pain_event_id", "embedding_vector", DIM))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of events linked at 0.85, directly or over a chain: the members of the tops, at 0.85, of the condensed hierarchies with min_samples 2."""
    return density.pairs_of_groups(density.tops(_routed(spark, folder), DIM, LINK), "label", "id", "event_a", "event_b")


#: Of a cluster: nearest events that make one dense (itself included), least size, exemplars.
MIN_SAMPLES, LEAST, EXEMPLARS = 3, 5, 5


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, size, stability, exemplars, typical_problem): dense clusters of at least 5 events, most typical first; the problem text of the most typical."""
    found, _ = density.clusters(_routed(spark, folder), DIM, MIN_SAMPLES, LINK, LEAST, EXEMPLARS)
    problems = current_rows(table(spark, folder, "pain_events"), "id", "extracted_at", ["problem"]).select(F.col("id").alias("first"), "problem")
    named = found.withColumn("first", F.try_element_at("exemplars", F.lit(1))).join(problems, "first", "left")
    return named.select("cluster_id", "size", F.round("stability", 6).alias("stability"), "exemplars", F.col("problem").alias("typical_problem"))


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, cluster_id): the members of the clusters of p1_clusters."""
    _, members = density.clusters(_routed(spark, folder), DIM, MIN_SAMPLES, LINK, LEAST, EXEMPLARS)
    return members.withColumnRenamed("id", "event_id")


def v07_dbscan(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, label): density clustering at cosine distance 0.15 with two samples; a label is the least id of its group, noise is left out."""
    members = cut(density.tops(_routed(spark, folder), DIM, LINK))
    least = members.groupBy("label").agg(F.min("id").alias("least"))
    return members.join(least, "label").select(F.col("id").alias("event_id"), F.col("least").alias("label"))


def v08_vector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """(label, size) of the groups of v07_dbscan."""
    return v07_dbscan(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def v09_clusters_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """(source, label, size): the groups of v07_dbscan by the source of their events, of at least 4 events."""
    source = current_rows(table(spark, folder, "pain_events"), "id", "extracted_at", ["source_type"]).select(F.col("id").alias("event_id"), F.coalesce("source_type", F.lit("post")).alias("source"))
    sizes = v07_dbscan(spark, folder).join(source, "event_id").groupBy("source", "label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.filter("size >= 4")


def _post_texts(spark: SparkSession, folder: str) -> DataFrame:
    posts = current_wide_rows(table(spark, folder, "posts"), "id", "collected_at", ["title", "body"])
    return posts.select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of posts of at least 30 words each whose counted words have a similarity of at least 0.7."""
    pairs, classes = neardup.near_pairs(_post_texts(spark, folder), 0.7, 30)
    return neardup.expanded(pairs, classes, "post_a", "post_b")


def _post_fields(spark: SparkSession, folder: str) -> DataFrame:
    posts = current_wide_rows(table(spark, folder, "posts"), "id", "collected_at", ["title", "body"])
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "body")])
    return posts.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.text")


def p3_masked(spark: SparkSession, folder: str) -> DataFrame:
    """(post_id, field_name, kinds, masked): both fields of every post with typed placeholders for personal information."""
    fields = _post_fields(spark, folder)
    return pii.masked_texts(fields, pii.learn(fields)).select(F.col("id").alias("post_id"), F.col("field").alias("field_name"), "kinds", "masked")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per post, field and kind of personal information held."""
    return p3_masked(spark, folder).select("post_id", "field_name", F.explode("kinds").alias("pii_kind"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one event has the other among its 5 most similar, at a cosine of at least 0.85."""
    near = vectors.nearest(_routed(spark, folder), DIM, NEAREST, LINK)
    return near.select(F.least("a", "b").alias("event_a"), F.greatest("a", "b").alias("event_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, neighbour, cosine, place): of every event its up to 5 most similar ones with a cosine of at least 0.85."""
    from pyspark.sql import Window

    near = vectors.nearest(_routed(spark, folder), DIM, NEAREST, LINK)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    return near.select(F.col("a").alias("event_id"), F.col("b").alias("neighbour"), F.round("w", 6).alias("cosine"), place.alias("place"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """(source, subreddit, id, pain_score, keep_permille) of the rows problem 5 is about."""
    rows = current_rows(table(spark, folder, "filtered_posts"), "id", "filtered_at", ["subreddit", "pain_score"])
    rows = rows.select("id", subreddit_name(F.col("subreddit")).alias("subreddit"), "pain_score").filter((F.col("subreddit") != "") & F.col("pain_score").between(0, 1))
    posts = current_rows(table(spark, folder, "posts"), "id", "collected_at", ["source"]).select("id", source_name(F.col("source")).alias("source"))
    targets = table(spark, folder, "keep_targets").select(source_name(F.col("source")).alias("source"), "keep_permille").dropDuplicates(["source"])
    return cut(rows.join(posts, "id").join(bounded(targets), "source"))


def p5_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """(source, subreddit, n, target, cutoff, kept) per group."""
    return cutoffs.cutoffs(_scored(spark, folder), ["source", "subreddit"], "pain_score", "keep_permille")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with a score at or above the cutoff of their source and subreddit."""
    rows = _scored(spark, folder)
    limits = cutoffs.cutoffs(rows, ["source", "subreddit"], "pain_score", "keep_permille").select("source", "subreddit", "cutoff")
    return rows.join(bounded(cut(limits)), ["source", "subreddit"]).filter("pain_score >= cutoff").select(F.col("id").alias("post_id"))


#: Records an author keeps.
CAP = 5


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "filtered_posts"), "id", "filtered_at", ["author", "pain_score"])
    rows = rows.select("id", author_name(F.col("author")).alias("author"), "pain_score").filter(~F.col("author").isin("", "[deleted]") & F.col("pain_score").between(0, 1))
    return capping.positions(rows, "author", "pain_score", "id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Posts beyond the 5 best of their author."""
    return _positions(spark, folder).filter(F.col("position") > CAP).select(F.col("id").alias("post_id"))


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """(post_id, author, position): the posts that remain, at most 5 an author."""
    return _positions(spark, folder).filter(F.col("position") <= CAP).select(F.col("id").alias("post_id"), "author", "position")


def p8_ids(spark: SparkSession, folder: str, tokenizers: str = bpe.FOLDER) -> DataFrame:
    """(doc_id, ids) of each document by byte_bpe_50k; an empty list for an empty and for a null text."""
    ranks = bpe.read_ranks(f"{tokenizers}/byte_bpe_50k.tiktoken")
    return bpe.encoded(table(spark, folder, "documents"), "doc_id", "text", ranks)


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id, exact, altered, changed): template windows of 13 words shared with the item's own values in the slots, and with other numbers, names or units."""
    return leaks.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an item's passage: template windows whose slots hold the item's own values."""
    return p9_leaks(spark, folder).filter("exact > 0").select("doc_id", "item_id")


def p10_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, subjects, mentions) of every document."""
    known = subjects.labelled(table(spark, folder, "subject_examples"), "example_id", "text", "subjects")
    return subjects.classified(table(spark, folder, "documents"), "doc_id", "text", known).withColumnRenamed("key", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and subject area."""
    return p10_subjects(spark, folder).select("doc_id", F.explode("subjects").alias("subject"))


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, documents, share): the corpus by subject; documents of two subjects count for both, share is of all documents."""
    every = cut(p10_subjects(spark, folder))
    total = every.count()
    named = every.select(F.explode("subjects").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return named.withColumn("share", F.round(F.col("documents") / max(1, total), 6))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:1] in "pv" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from siftspark.llm.oracles import SQL

    return dict(SQL)
