"""Tables that cut lineage: rows written once to a folder that driver and executors share, and read from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session, as in tests, has one under its warehouse; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut_lineage"
    return at.rstrip("/")


class Scratch:
    """The tables of one job, in a folder of its own."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table: later reads don't compute it again, and survive lost executors."""
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that written() gave and nothing reads any more."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that stays."""
    return Scratch(df.sparkSession, name).written(df, name)
