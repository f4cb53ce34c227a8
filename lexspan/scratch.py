"""Tables that a job writes for itself into the folder that driver and executors share (`spark.checkpoint.dir`)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path there. Only where the setting is missing on one machine, as in a test, a temporary folder is made and put there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lexspan/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet and read again: what is behind it is done once, and not again when an executor is lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
