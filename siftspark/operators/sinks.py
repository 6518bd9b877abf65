"""Sinks: appends with ids, upserts into versioned folders, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.merge import merge_upsert
from siftspark.plans.scratch import cut


def with_next_ids(rows: DataFrame, order: list[str], name: str = "id", after: int = 0) -> DataFrame:
    """``rows`` with consecutive ids from ``after + 1`` on, in ``order``.

    A range sort puts the rows in order over all partitions, each partition numbers its own, and the partitions' counts
    (one number each, bounded by their count) give the offsets; no row passes through a single task. ``order`` should be total: equal rows may swap.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inside = F.monotonically_increasing_id()
    # of a number that grows within a partition the low 33 bits count its rows, so a sorted partition numbers itself
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__i", inside)
    placed = cut(placed.withColumns({"__p": F.shiftrightunsigned("__i", 33).cast("int"), "__l": F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("__i"))
    counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], after
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    table = rows.sparkSession.createDataFrame(offsets or [(0, after)], "__p int, __o long")
    return placed.join(F.broadcast(table), "__p").withColumn(name, F.col("__o") + F.col("__l")).drop("__p", "__l", "__o")


#: Parts of a versioned folder, by a hash of the key; an upsert rewrites those that its batch touches.
PARTS = 64


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm.org.apache.hadoop.fs.Path, base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest_version(spark: SparkSession, folder: str) -> list[str]:
    """The paths that make up the newest version under ``folder``; none if there is no version."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    versions = sorted(n for s in fs.listStatus(path(folder)) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))
    return json.loads("".join(r[0] for r in spark.read.text(f"{folder}/{versions[-1]}").collect())) if versions else []


def upsert_folder(spark: SparkSession, folder: str, batch: DataFrame, key: str, at: str) -> str:
    """Merge ``batch`` into the newest version under ``folder`` and publish the next one; returns its manifest.

    Rows lie in ``PARTS`` parts by a hash of the key, and only parts that the batch touches are read and written again. A version is a manifest that names
    its parts; it becomes visible when all files are written, by renaming a draft, and if another writer has published the same number first this raises.
    Readers keep the parts they opened. Running the same batch again changes nothing.
    """
    path, fs = _fs(spark, folder)
    fs.mkdirs(path(folder))
    versions = sorted(n for s in fs.listStatus(path(folder)) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))
    old = {int(p.rsplit("part=", 1)[1]): p for p in newest_version(spark, folder)}
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    batch = cut(batch.filter(F.col(key).isNotNull()))
    touched = sorted(r[0] for r in batch.select(part.alias("p")).distinct().collect())
    mine = [old[p] for p in touched if p in old]
    before = spark.read.parquet(*mine) if mine else batch.limit(0)
    merged = merge_upsert(before, batch, key, at, [c for c in dict.fromkeys([*before.columns, *batch.columns]) if c not in (key, at)])
    target = f"{folder}/data-{uuid.uuid4().hex}"
    merged.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(target)
    paths = old | {p: f"{target}/part={p}" for p in touched}
    number = int(versions[-1][1:9]) + 1 if versions else 0
    draft, final = path(f"{folder}/.{uuid.uuid4().hex}"), path(f"{folder}/v{number:08d}.json")
    out = fs.create(draft)
    out.write(bytearray(json.dumps([paths[p] for p in sorted(paths)]).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another writer has published {final}")
    return str(final)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a folder that ``upsert_folder`` wrote."""
    return spark.read.parquet(*newest_version(spark, folder))


def json_report(rows: DataFrame, path: str, limit: int = 5) -> bool:
    """Write at most ``limit`` rows (a shortlist) as one JSON file; nothing is written for an empty one. Returns whether it was."""
    short = rows.limit(limit)
    if not short.head(1):
        return False
    short.coalesce(1).write.mode("overwrite").json(path)
    return True


def markdown_report(rows: DataFrame, title: str, name: str, fields: list[str], limit: int = 5) -> str:
    """A heading and a section per row of a shortlist of at most ``limit`` rows; nulls are shown as a dash."""
    sections = [f"# {title}"]
    for r in rows.limit(limit).collect():
        sections.append("\n".join([f"## {r[name]}", *[f"- {f}: {'-' if r[f] is None else r[f]}" for f in fields]]))
    return "\n\n".join(sections) + "\n"
