"""The folder that driver and executors share, and tables settled in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, where all are one
    machine, may leave it unset and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: sorted and merged, not sent to every executor. The planner goes by the
    bytes of files, and tables of exploded rows or of few distinct values are many times what their files are, so left to
    itself it collects them on the driver."""
    return df.hint("merge")


def settled(df: DataFrame, label: str) -> DataFrame:
    """A table written and read back: cuts the lineage of iterative work and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
