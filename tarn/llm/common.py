"""Helpers shared by the corpus operators: table access, cutting lineage, shared folders."""

from __future__ import annotations

import ctypes
import gc
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row, however often body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where it is unset, in local runs, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarn-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; the file system removes it when the driver ends."""
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads never run its plan again, nor lose it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def from_driver(spark: SparkSession, rows: Iterable[tuple], schema: str, name: str) -> DataFrame:
    """Rows that the driver has, as a table in the shared folder: JSON lines that Spark's own reader reads, without Python workers."""
    path = new_path(spark, name)
    kind = StructType.fromDDL(schema)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-0.json")
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    rows = iter(rows)
    while some := list(islice(rows, 20_000)):
        lines = "".join(json.dumps(dict(zip(kind.names, r, strict=True))) + "\n" for r in some)
        out.write(lines.encode("ascii"))
    out.close()
    return spark.read.schema(kind).json(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/tarn/" in f:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(f)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows go to Python workers in batches of about so many bytes, or one row: a task's memory doesn't grow with long texts.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of BATCH_BYTES at most; a smaller bound of the session's own stays.

    Workers live on for other tasks, so what a task has used goes back to the system at its end.
    """
    conf, units = df.sparkSession.conf, {"": 0, "k": 10, "m": 20, "g": 30}
    own = re.fullmatch(r"(\d+)\s*([kmg]?)b?", str(conf.get(_BATCH_CONF)).lower())
    if not own or not 0 < int(own[1]) << units[own[2]] <= BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Returns this process's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def redealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with whole-numbered keys that a join deals out anew after a grouping by them: only then can it split a hot key."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0)) for k in keys})


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (bigint) and text of docs and the named columns, whatever else it has; a null text stays null."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


_LOCAL = (1 << 33) - 1


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with rank__ (from 0 within its group) and total__ (rows of its group), as a written table.

    Rows are dealt by ranges of (group, order) and sorted there; a row's rank is its place in its partition plus the
    group's rows in earlier partitions, of which there are few numbers. So a group of any size is spread, and no
    window holds it. Ties are broken by the place in the input; null groups are groups, null keys come first.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)] + [F.col("tie__")]
    d = df.withColumn("tie__", F.monotonically_increasing_id())
    d = d.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie__").withColumn("at__", F.monotonically_increasing_id())
    d = written(d.withColumn("part__", F.shiftright("at__", 33)).withColumn("at__", F.col("at__").bitwiseAND(F.lit(_LOCAL))), name)
    n = d.groupBy(*group, "part__").agg(F.count("*").alias("n__"), F.min("at__").alias("low__"))
    by = Window.partitionBy(*group)
    n = n.select(*group, "part__", (F.coalesce(F.sum("n__").over(by.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("low__")).alias("before__"), F.sum("n__").over(by).alias("total__"))
    n = n.toDF(*[f"{c}__of" if c in group else c for c in n.columns])
    on = [F.col(c).eqNullSafe(F.col(f"{c}__of")) for c in group]
    out = d.withColumnRenamed("part__", "own__").join(n, [F.col("own__") == F.col("part__"), *on])
    return out.withColumn("rank__", F.col("at__") + F.col("before__")).select(*df.columns, "rank__", "total__")
