"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the engine wants; safe to call on any session, any number of times.

    Pages are wide rows, so the Arrow batches that feed the node job are kept small.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="pagetable-")


class Stage:
    """Tables written while an iterative operator runs.

    Writing cuts the lineage, survives lost executors and gives the next step exact sizes. The
    folder stays, since the frames an operator returns read from it; once they are done with, the
    caller may ``clear`` a stage of its own or leave all to the cluster's clean-up of its checkpoint
    folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self._spark = spark
        self._root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self._root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(self.path(table))
        return self._spark.read.schema(df.schema).parquet(self.path(table))

    def clear(self) -> None:
        """Deletes what the stage has written; frames that read from it no longer work."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._root)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
