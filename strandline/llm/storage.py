"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs on one machine, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        found = context.getCheckpointDir()
    return found


#: Rows of an Arrow batch of texts: few, so that a batch of long texts is small on either side.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> SparkSession:
    """Lowers the session's rows for each Arrow batch to BATCH_ROWS, where more are allowed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark


class Workspace:
    """Writes tables below the shared folder, cutting lineage, and drops those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = small_batches(spark), f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished jobs, which otherwise wait for a collection on the driver."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
