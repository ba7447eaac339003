"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def workspace(spark: SparkSession, purpose: str) -> str:
    """A new folder path under the cluster's checkpoint folder.

    Only a local session without that setting gets a temporary folder, one for the application, which goes
    when Python ends; on a cluster a machine-local path would be lost with its machine.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        base = _local.get(spark.sparkContext.applicationId)
        if base is None:
            base = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="reportlens-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str, *partitions: str) -> DataFrame:
    """Write once and read back: cuts the lineage and keeps several consumers from recomputing.

    With `partitions`, rows are dealt by them first, so that a folder holds few files and a filter on them prunes.
    """
    spark = df.sparkSession
    path = workspace(spark, purpose)
    laid_out = df.hint("rebalance", *partitions) if partitions else df
    laid_out.write.partitionBy(*partitions).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns) if partitions else back


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per byte: AQE deals the rows out in partitions of its advisory size."""
    return df.hint("rebalance")
