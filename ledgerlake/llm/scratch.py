"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.sources.shared import shared_folder


class Scratch:
    """Tables that one operator call writes and reads again: they cut lineage and survive lost executors.

    ``drop`` removes those that nothing later reads. A table that a returned DataFrame still reads stays until the
    shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        kept = self.spark.read.schema(df.schema).parquet(where)
        kept._scratch_path = where
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Also has the driver look for what is no longer used, so that Spark removes the shuffle files of finished steps."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark._jvm.System.gc()
