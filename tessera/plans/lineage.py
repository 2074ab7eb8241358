"""Cutting lineage in loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; set here only where it is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/tessera-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a copy in spark.checkpoint.dir, which all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
