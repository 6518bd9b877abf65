"""Cutting lineage through tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only where the session names none and runs in one local JVM (tests), a folder of its own is
    made. On a cluster without that setting this raises, as a machine-local folder would not do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="shared_"))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone
        pass


def cut(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Losing an executor then costs at most one stage. An empty input gives an empty table of the
    same schema. The table is removed when the Python process ends, the shuffle files behind it as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table made by ``cut`` that no plan needs any more."""
    for path in {p.rsplit("/part-", 1)[0] for p in df.inputFiles()}:
        if "/cut-" in path:
            _remove(df.sparkSession, path)
