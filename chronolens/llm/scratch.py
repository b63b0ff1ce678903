"""Cutting lineage through written tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the setting is absent and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronolens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Parquet tables under one fresh directory of the shared folder.

    A written table replaces a DataFrame's lineage, so a lost executor costs
    only the tasks that were reading it.  ``drop`` deletes a table whose
    readers are done; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = self.paths.pop(id(table), None) if table is not None else None
            if path:
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def free_shuffles(self) -> None:
        """Lets Spark delete the shuffle files of plans that no Python object holds any more."""
        import gc

        gc.collect()
        self.spark.range(1).collect()  # the session still holds the plan that ran last
        self.spark._jvm.System.gc()
