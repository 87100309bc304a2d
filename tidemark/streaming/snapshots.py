"""Tables that a stream keeps between batches, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import common

VERSION = "batch="


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{common.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


class Snapshots:
    """One version of a table for each batch.

    A batch reads the version before it and writes its own.  A batch that is
    repeated after a failure reads and rewrites the same versions, so its
    effect is that of one run.
    """

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder, schema

    def version(self, spark: SparkSession, batch: int) -> DataFrame:
        """The table after ``batch``; empty before the first."""
        if batch < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.folder}/{VERSION}{batch}")

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{VERSION}{batch}")

    def latest(self, spark: SparkSession) -> DataFrame:
        """The table after the last batch."""
        name = VERSION.removesuffix("=")
        rows = spark.read.schema(f"{self.schema}, {name} long").parquet(self.folder)
        last = rows.agg(F.max(name)).first()[0]
        return self.version(spark, -1 if last is None else last)

    def all_batches(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The rows that all batches, or those ``before`` one, wrote; for tables that only grow."""
        name = VERSION.removesuffix("=")
        rows = spark.read.schema(f"{self.schema}, {name} long").parquet(self.folder)
        return (rows if before is None else rows.where(F.col(name) < before)).drop(name)
