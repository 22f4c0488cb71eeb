"""Intermediate tables in the folder that all executors share.

A written table ends lineage, has the true size, and outlives the executor that wrote it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spandrel.operators.components import checkpoint_folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of numbered tables that go together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written here."""
        path, self.tables = f"{self.folder}/{self.tables}", self.tables + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self, result: DataFrame) -> DataFrame:
        """``result`` written outside; all tables of the folder go."""
        out = written(result)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out
