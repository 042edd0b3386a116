"""Graphs that last: triples as Parquet snapshots below a folder, and numbered versions that name them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarn.sources.graphs import COLUMNS, TRIPLES, TriplesGraph


class GraphChanged(RuntimeError):
    pass


class StoredGraph(TriplesGraph):
    """The graph in a folder of any file system of Spark's; a folder without versions is an empty graph.

    A change writes a snapshot of its own, then the next version, a small file with the snapshot's name that is moved
    into place. So readers see the graph before or after it, a writer that dies leaves no trace in it, and of two writers
    who start from the same version the second gets GraphChanged, refreshes and tries again (for certain where a move
    refuses an existing file, as on HDFS; elsewhere two must not move in the same instant). An update of several graphs
    swaps one after the other. Old snapshots serve those who still read them, until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.made = spark, path.rstrip("/"), None
        self.refresh()

    def _file(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._file().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        fs = self._files()
        if not fs.exists(self._file()):
            return []
        return sorted(n for s in fs.listStatus(self._file()) if (n := s.getPath().getName()).startswith(kind))

    def refresh(self) -> None:
        """Takes the latest version."""
        self.version, self.name, self.counts = 0, "", None
        if files := self._names("version-"):
            stream = self._files().open(self._file(files[-1]))
            self.version, self.name = int(files[-1].removeprefix("version-")), self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        self.df = self._read(self.name) if self.name else self.spark.createDataFrame([], TRIPLES)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TRIPLES).parquet(f"{self.path}/{name}")

    def snapshot(self, df: DataFrame) -> DataFrame:
        name = f"snapshot-{uuid.uuid4().hex}"
        df.select(*COLUMNS).write.parquet(f"{self.path}/{name}")
        self.made = self._read(name), name
        return self.made[0]

    def swap(self, df: DataFrame) -> None:
        if self.made is None or df is not self.made[0]:
            df = self.snapshot(df)
        fs, name = self._files(), self.made[1]
        new, place = self._file(f"new-{name}"), self._file(f"version-{self.version + 1:020}")
        out = fs.create(new, False)
        out.writeBytes(name)
        out.close()
        if fs.exists(place) or not fs.rename(new, place):
            fs.delete(new, False)
            raise GraphChanged(f"{self.path} has a version after {self.version}")
        self.version, self.name, self.df, self.counts, self.made = self.version + 1, name, df, None, None

    def drop(self) -> None:
        self.clear()

    def vacuum(self) -> None:
        """Deletes the snapshots and versions before the current one; nobody may be reading or writing them."""
        fs = self._files()
        for file in [*self._names("snapshot-"), *self._names("new-"), *self._names("version-")[:-1]]:
            if file != self.name:
                fs.delete(self._file(file), True)
