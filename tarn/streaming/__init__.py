"""Streams of triples as graphs.

Single patterns, FILTER, BIND, UNION and projection compile to operators that Structured Streaming runs as they are;
joins of patterns are stream-stream joins, whose state a watermark on the source bounds.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tarn.sources.graphs import TRIPLES, TriplesGraph


def stream_graph(spark: SparkSession, path: str, max_files: int | None = None) -> TriplesGraph:
    """A folder of Parquet files of triples, read as a stream: new files are new triples."""
    reader = spark.readStream.schema(TRIPLES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return TriplesGraph(reader.parquet(path))
