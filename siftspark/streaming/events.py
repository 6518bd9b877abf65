"""Structured Streaming: upserts, windows, sessions, online cluster assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators import clusters
from siftspark.operators.sinks import newest_version, upsert_folder
from siftspark.plans.bounds import bounded
from siftspark.plans.scratch import cut


def upsert_stream(stream: DataFrame, folder: str, key: str, at: str, checkpoint: str):
    """Start a query that merges every micro-batch into the versioned folder; newest ``at`` wins, so late and repeated deliveries are harmless."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert_folder(batch.sparkSession, folder, batch, key, at)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_deliveries(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Rows whose key was not seen within the watermark: the streaming form of an incremental scan."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 day", late: str = "14 days") -> DataFrame:
    """(start, by..., n) of tumbling windows; rows later than the watermark are dropped by it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, at: str, owner: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(owner, start, end, n): a session of an owner ends after a ``gap`` without rows."""
    grouped = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), owner)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(owner, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def assignment_stream(stream: DataFrame, folder: str, dim: int, checkpoint: str):
    """Start online assignment of a stream of events (id, v, at) over the versioned folder of members (id, v, at, cluster_id, updated).

    Each micro-batch is decided by ``clusters.assigned`` against the newest version: events join a cluster, found one with three orphans, whose id is then the founder's,
    or become orphans (cluster_id null); founders' members move with them. Running a batch again changes nothing, as the decisions are upserted by id.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch.filter("id IS NOT NULL").select("id", "v", "at"))
        paths = newest_version(spark, folder)
        empty = batch.limit(0).withColumns({"cluster_id": F.lit(None).cast("long"), "updated": F.lit(0).cast("long")})
        state = spark.read.parquet(*paths) if paths else empty
        old = state.join(bounded(batch.select("id")), "id", "left_anti")
        found = cut(clusters.assigned(batch, old.filter("cluster_id IS NOT NULL"), old.filter("cluster_id IS NULL"), dim))
        into = found.filter("member IS NOT NULL").select(F.col("member").alias("id"), "cluster_id").groupBy("id").agg(F.min("cluster_id").alias("to"))
        every = batch.unionByName(old.join(into, "id", "left_semi").select("id", "v", "at"))
        rows = every.join(into, "id", "left").select("id", "v", "at", F.col("to").alias("cluster_id"), F.lit(number + 1).cast("long").alias("updated"))
        upsert_folder(spark, folder, rows, "id", "updated")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder, ``files`` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
