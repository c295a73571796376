"""The folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local session that names none (tests) has one under its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def plain_unions(spark: SparkSession) -> None:
    """Unions don't say how their inputs are partitioned: inputs whose partitions are merged differently at run time would leave rows of one key in
    several partitions, and an aggregate that trusts the partitioning would give that key several rows."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: later steps start from it, also after executors are lost."""
    plain_unions(df.sparkSession)
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
