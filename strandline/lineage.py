"""Cutting lineage in loops, through the checkpoint folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.  A temporary folder is used only where none is set and all runs on
    one machine, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed and written to the shared folder, so that they outlive their executors and later plans start there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
