"""Cutting lineage, and ranks over whole tables, without one task for all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see; where it is unset, in local runs, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarn-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rank from 0 in that order: rows are dealt by ranges and sorted, partitions add up their counts."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    d = d.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in d.groupBy("__part").count().collect()):  # a row for each partition
        starts.append((part, before))
        before += n
    s = df.sparkSession.createDataFrame(starts, "__part bigint, __before bigint")
    return d.join(F.broadcast(s), "__part").withColumn(name, F.col("__at") + F.col("__before")).select(*df.columns, name)
