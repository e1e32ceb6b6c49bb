"""Intermediate tables kept in the cluster's shared folder.

A written table cuts lineage and survives the loss of executors; the rows an
iterative step goes on with are exactly those that were committed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would not be visible to the executors, so it is refused.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):  # not local-cluster
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallybridge-"))
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """A folder of intermediate tables that can be dropped as a whole."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tallybridge-{uuid.uuid4().hex}"
        self._tables = 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write a table and return it as read back."""
        self._tables += 1
        target = f"{self.path}/{self._tables:05d}"
        df.write.mode("error").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
