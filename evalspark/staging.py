"""Rows written to shared storage, so that later steps read them back instead of recomputing them."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_own_folder(spark: SparkSession) -> None:
    """Name a folder for a session on one machine that names none, such as a test or a trial."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="evalspark-"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. The caller names it, and removes what a run left there.

    Everything staged lies below ``<folder>/evalspark/<application id>``; nothing reads it after
    the application has ended.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/evalspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str | None = None, name: str = "stage") -> DataFrame:
    """Write the rows once and return a scan of them; lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
