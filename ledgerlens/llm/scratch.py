"""Intermediate tables in the shared folder: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .base import checkpoint_dir


class Scratch:
    """Writes tables under one folder of spark.checkpoint.dir. drop() removes one that nothing reads any more; what
    a result still reads stays until clear(), or goes with the application (Hadoop's deleteOnExit)."""

    def __init__(self, spark):
        self.spark, self.folder, self.paths = spark, f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", {}
        self._fs(self._path(self.folder)).deleteOnExit(self._path(self.folder))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._path(self.paths[id(t)][0])
            self._fs(path).delete(path, True)

    def clear(self) -> None:
        path = self._path(self.folder)
        self._fs(path).delete(path, True)
