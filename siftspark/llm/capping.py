"""Capping the records of dominant contributors by exact positions in a global range sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from siftspark.plans.scratch import cut


def positions(rows: DataFrame, owner: str, score: str, key: str) -> DataFrame:
    """``rows`` with ``position``: the place (from 1) of each row among its owner's, highest score first, then least key.

    The rows are sorted over the whole cluster by (owner, score, key), so a dominant owner simply spans several partitions.
    A pass over each sorted partition numbers the rows inside their run of one owner and reports the runs at its two edges;
    the edges (at most two per partition, so bounded by the partition count) give the offset of a run that began in earlier
    partitions. No shuffle by owner. Rows with a null owner, score or key are left out; repeated rows
    count one by one.
    """
    names = [owner, score, key]
    rows = rows.filter(F.col(owner).isNotNull() & F.col(score).isNotNull() & F.col(key).isNotNull())
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(owner), F.desc(score), F.col(key)]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = ordered.schema

    def number(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        current, count, first = None, 0, True
        for batch in batches:
            owners = batch.column(names_at[0]).to_pylist()
            local = np.empty(len(owners), np.int64)
            head = np.zeros(len(owners), bool)
            for i, o in enumerate(owners):
                if o != current:
                    first = first and current is None
                    current, count = o, 0
                count += 1
                local[i] = count
                head[i] = first
            extra = [pa.array(np.full(len(owners), part, np.int32)), pa.array(local), pa.array(head)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "__part", "__local", "__head"])

    names_at = [schema.fieldNames().index(n) for n in names]
    out = StructType([*schema.fields, StructField("__part", IntegerType()), StructField("__local", LongType()), StructField("__head", BooleanType())])
    numbered = cut(ordered.mapInArrow(number, out))
    # the last run of every partition: what a run at the head of a later partition continues
    runs = numbered.groupBy("__part").agg(F.max(F.struct(F.col(owner).alias("o"), "__local")).alias("last"), F.min(owner).alias("head"), F.count(F.lit(1)).alias("n"))
    offsets, carried_owner, carried = [], None, 0
    for r in sorted(runs.collect(), key=lambda r: r["__part"]):
        offset = carried if r["head"] == carried_owner else 0
        offsets.append((r["__part"], offset))
        last_owner, last_n = r["last"]["o"], r["last"]["__local"]
        carried = last_n + (offset if last_owner == r["head"] else 0)
        carried_owner = last_owner
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __offset long")
    whole = numbered.join(F.broadcast(table), "__part").withColumn("position", F.col("__local") + F.when(F.col("__head"), F.col("__offset")).otherwise(0))
    return whole.drop("__part", "__local", "__head", "__offset")
